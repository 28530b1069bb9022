"""Each operator against a plain version of its contract on small texts."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiltext.llm import decontaminate, languages, licenses, mixing, personal_data, quality, secrets, simhash, tokens, toxicity
from civiltext.llm.common import stored
from civiltext.llm.queries import QUERIES
from corpus_pipeline import STAGES, run

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def query(n):
    return QUERIES[next(name for name in QUERIES if name.startswith(f"op{n}_"))]


def over_documents(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


# --- 1: secrets ----------------------------------------------------------------------------

PLAIN_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
)


def plain_secrets(text):
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, group, least) in enumerate(PLAIN_RULES) for m in re.finditer(pattern, text) if len(m[group]) >= least
    ]
    return sorted(found)


def secret_texts():
    rng = random.Random(5)
    pieces = ["password", "API_KEY", "apikey", "Token", "secret", "passwd", ": ", " = ", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abc", "é𝄞", "x" * 9, "\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(150)]


def test_secrets_equal_the_patterns(spark, tables):
    texts = secret_texts()
    for r in query(1)(spark, tables([(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        found = plain_secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[3] == k for f in found) for k, *_ in PLAIN_RULES)
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


def test_ledger_scans_only_unseen_pairs(spark, path):
    versions = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", "nothing")], "path string, text string")
    first = secrets.update_ledger(versions, path("ledger"))
    assert first.count() == 2 * len(secrets.RULES)
    assert secrets.update_ledger(versions, path("ledger")).count() == 2 * len(secrets.RULES)
    newer = (secrets.Rule("assign", 2, "nothing"), *secrets.RULES[1:])
    more = versions.unionByName(spark.createDataFrame([("d", "nothing new")], versions.schema))
    ledger = secrets.update_ledger(more, path("ledger"), newer)
    assert ledger.count() == 2 * len(secrets.RULES) + len(newer) + 2
    found = {r.path: [(s.kind, s.start, s.stop) for s in r.found] for r in secrets.findings(more, ledger, "path", newer).collect()}
    assert found == {"a": [], "b": [], "c": [("assign", 0, 7)], "d": [("assign", 0, 7)]}
    old = {r.path: len(r.found) for r in secrets.findings(more, ledger, "path").collect()}
    assert old == {"a": 1, "b": 1, "c": 0, "d": 0}


@pytest.mark.parametrize("text", [
    "-----BEGIN " + "AB " * 700_000, "eyJ" * 500_000, "token: " * 300_000, "AKIA" * 400_000, "f" * 2_000_000, "xoxb-" * 300_000, "-----BEGIN " * 100_000,
], ids=lambda t: t[:6])
def test_long_repetitive_texts(spark, text):
    """Megabytes that every rule starts to match again and again end in time and without deep recursion."""
    row = spark.createDataFrame([(text,)], "text string")
    counts = row.select(*[F.size(secrets.rule_spans(F.col("text"), r)).alias(r.kind) for r in secrets.RULES]).first()
    plain = [len([m for m in re.finditer(p, text) if len(m[g]) >= n]) for _, p, g, n in PLAIN_RULES]
    assert list(counts[:3]) == plain and counts["private_key"] == 0


def test_rerun_moves_no_known_texts(spark, path, monkeypatch):
    versions = spark.createDataFrame([(str(i), f"token=abcdefgh{i}") for i in range(50)], "path string, text string")
    secrets.update_ledger(versions, path("ledger"))
    grouped = []
    monkeypatch.setattr(secrets, "rule_spans", lambda text, rule, real=secrets.rule_spans: grouped.append(rule) or real(text, rule))
    more = versions.unionByName(spark.createDataFrame([("new", "token=otherword1")], versions.schema))
    moved = spark._jsparkSession.sharedState().statusStore()
    before = moved.executionsList().size()
    ledger = secrets.update_ledger(more, path("ledger"))
    assert ledger.count() == 51 * len(secrets.RULES)
    plans = [moved.executionsList().apply(i).physicalPlanDescription() for i in range(before, moved.executionsList().size())]
    # the texts pass the broadcast of unseen ids before they are exchanged
    writing = next(p for p in plans if "regexp_extract_all" in p and "LeftSemi" in p)
    assert "BroadcastHashJoin" in writing


# --- 2: mixing -----------------------------------------------------------------------------


def plain_targets(sizes, weights, share=1.5, most=2.0):
    left, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > most * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_mixture_meets_its_targets(spark, tables):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(1, 40)), "en", rng.choice(["a", "b", "ä", "c", "Z", None, "big", "big", "big"])) for i in range(900)]
    folder = tables(docs)
    rows = query(2)(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id][1])) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(r.source_size == sizes[r.source] for r in rows)
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    expected = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sorted(rows) == sorted(query(2)(spark, folder).collect())


@pytest.mark.parametrize("share", [300, 800])
def test_equal_rows_are_decided_one_by_one(spark, tables, share):
    """A source most of whose rows are equal in id and size meets its target as others do."""
    docs = [(None if i < share else i, " ".join(["word"] * 100), "en", "big") for i in range(900)] + [(2000 + i, "a b c", "en", "small") for i in range(300)]
    rows = [r for r in query(2)(spark, tables(docs)).collect() if r.source == "big"]
    assert len(rows) == 900 and abs(sum(r.taken for r in rows) - rows[0].target) <= 51
    assert {r.taken for r in rows} <= {0, 100, 200}


def test_mixture_does_not_depend_on_the_partitions(spark, tables):
    rng = random.Random(13)
    docs = [(rng.choice([None, i, i // 3]), "w " * rng.randrange(1, 9), "en", rng.choice("abc")) for i in range(300)]
    sizes = [(i, s, len(t.split())) for i, t, _, s in docs]
    found = []
    for parts in (1, 7):
        frame = spark.createDataFrame(sizes, "id bigint, source string, size bigint").repartition(parts)
        frame = stored(frame.selectExpr("monotonically_increasing_id() AS row", "*"), "sizes")
        found.append(sorted(((r.id, r.source, r.size, r.copies) for r in mixing.mix(frame).collect()), key=str))
    assert found[0] == found[1]


def test_targets_of_many_sources(spark):
    rng = random.Random(14)
    sizes = {f"s{i:03d}": rng.randrange(1, 10 ** rng.randrange(1, 6)) for i in range(200)}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
    expected = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    assert {r.source: r.target for r in rows} == pytest.approx(expected)


def test_small_groups_and_levels(spark):
    items = spark.range(400).selectExpr("id AS row", "'s' AS source", "400L AS source_docs", "id", "1 + id % 7 AS size", "1L AS nth", "0.3D AS share")
    rows = mixing.pivotal_rounding(items, group=4).collect()
    assert sorted(r.row for r in rows) == list(range(400)) and {r.extra for r in rows} == {0, 1}
    assert abs(sum(r.extra * r.size for r in rows) - 0.3 * sum(r.size for r in rows)) <= 4


# --- 3: decontamination ----------------------------------------------------------------------


def plain_tiles(doc, item, run):
    """The definition: the longest unmarked common run is marked, until there is none of `run` words."""
    marked_doc, marked_item, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in marked_doc and j + k not in marked_item:
                    k += 1
                if k >= run and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return total
        k, i, j = best
        marked_doc.update(range(i, i + k))
        marked_item.update(range(j, j + k))
        total += k


def test_tiling_equals_its_definition(spark):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choice("abcde") for _ in range(rng.randrange(3, 25)))) for n in range(12)]
    docs = []
    for n in range(40):
        pieces = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(items)[1].split()
            cut = rng.randrange(len(words))
            pieces += [words[cut:], words[:cut], [rng.choice("abcxyz")]]
        docs.append((n, " ".join(w.upper() if rng.random() < 0.2 else w for p in pieces for w in p)))
    got = decontaminate.coverage(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    got = {(r.doc_id, r.item_id): r.coverage for r in got.collect()}
    for n, text in docs:
        for m, item in items:
            total = plain_tiles(text.lower().split(), item.split(), 5)
            assert got.get((n, m), 0.0) == pytest.approx(total / len(item.split())), (n, m)


def test_runs_equal_the_listed_pairs():
    rng = np.random.default_rng(4)
    for kinds in (1, 2, 3, 9):
        for _ in range(40):
            seeds, item = rng.integers(0, kinds, rng.integers(0, 30)), rng.integers(0, kinds, rng.integers(0, 20))
            places = np.sort(rng.choice(60, len(seeds), replace=False))
            pairs = {(int(p), j) for p, s in zip(places, seeds) for j, o in enumerate(item) if s == o}
            expected = []
            for i, j in pairs:
                if (i - 1, j - 1) not in pairs:
                    n = 1
                    while (i + n, j + n) in pairs:
                        n += 1
                    expected.append((i, j, n))
            for at_once in (4, 1 << 20):
                assert sorted(zip(*(x.tolist() for x in decontaminate.common_runs(places, seeds, item, at_once)))) == sorted(expected)


def test_very_repetitive_texts_are_tiled_in_time():
    [(i, j, n)] = decontaminate.tiles(np.arange(1_000_000), np.zeros(1_000_000, np.int64), np.zeros(396, np.int64))
    assert (i, j, n) == (0, 0, 400)
    [(i, j, n)] = decontaminate.tiles(np.arange(100_000), np.arange(100_000) % 2, np.arange(396) % 2)
    assert (i, j, n) == (0, 0, 400)


def test_reordered_passage_is_found(spark, tables):
    rng = random.Random(4)
    item = [prose(rng, 12) for _ in range(4)]
    docs = [(1, prose(rng, 50) + " " + "; ".join(x.title() for x in (item[2], item[0], item[3], item[1]))), (2, prose(rng, 90)), (3, item[0] + prose(rng, 20))]
    folder = tables([(i, t, "en", "s") for i, t in docs], benchmark=([(7, ". ".join(item))], "item_id bigint, text string"))
    assert [(r.doc_id, r.item_id) for r in query(3)(spark, folder).collect()] == [(1, 7)]


# --- 4: quality ------------------------------------------------------------------------------


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, tables):
    rng = random.Random(2)
    texts = ["", "one", " ".join("ab" for _ in range(50)), "a\n b\na\n\n b\n#"]
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdefgh<") for _ in range(rng.randrange(12))) for _ in range(4)]
        texts.append(rng.choice([" ", "\n", "\x0b"]).join(rng.choice(parts) for _ in range(rng.randrange(9))))
    for r in query(4)(spark, tables([(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        expected = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bad_host_goes_and_a_small_one_stays(spark):
    rows = [("good", i % 10 == 0) for i in range(300)] + [("bad", i % 20 > 0) for i in range(300)] + [("tiny", True)] + [(None, True)] * 3
    judged = spark.createDataFrame(rows, "host string, base_failed boolean")
    verdicts = {r.host: r for r in quality.host_verdicts(judged, "host").collect()}
    assert {h: v.host_ok for h, v in verdicts.items()} == {"good": True, "bad": False, "tiny": True}
    assert 0.3 < verdicts["tiny"].host_rate < 0.8


def test_documents_of_a_bad_host_go(spark, tables):
    """The query's verdict acts, and only on the host that surely fails too often."""
    rng = random.Random(12)
    docs = []
    for host, n, bad in (("good", 500, 0.05), ("fair", 100, 0.15), ("bad", 60, 0.6), ("tiny", 2, 0.5), (None, 6, 0.5)):
        docs += [(len(docs) + i, "too short" if i < bad * n else prose(rng, 40), "en", host) for i in range(n)]
    folder = tables(docs)
    rows = query(4)(spark, folder).collect()
    hosts = {i: h for i, _, _, h in docs}
    for r in rows:
        assert r.base_failed == (r.n_words < 20) and r.kept == (not r.base_failed and hosts[r.doc_id] != "bad"), r
    twin = {r[0]: r[-1] for r in over_documents(folder).execute(quality.SQL["op4_host_quality"]).fetchall()}
    assert twin == {r.doc_id: r.kept for r in rows}


# --- 5: near-duplicates ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_of_texts(spark, tables):
    rng = random.Random(6)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 4, 80, 300)]
    texts = base + [t.upper() for t in base] + [t + " tail" for t in base] + ["ÀÉ à"]
    rows = query(5)(spark, tables([(100 - i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    prints = {100 - i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


def test_components_of_fingerprints(spark):
    rng = random.Random(7)
    prints = {}
    for center in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            for bit in rng.sample(range(64) if center % 2 else range(16), rng.randrange(4)):
                p ^= 1 << bit
            prints[len(prints)] = p
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "id bigint, fp bigint")
    assert {r.id: r.component for r in simhash.near_duplicates(rows).collect()} == plain_components(prints)


def test_pairs_of_a_list():
    rng = np.random.default_rng(1)
    for n in (5, 100, 129, 700):
        rests = np.unique(rng.integers(0, 1 << (16 if n != 129 else 9), n))
        first, second = simhash.near_pairs(rests)
        near = np.bitwise_count(rests[:, None] ^ rests[None, :]) <= 2
        assert sorted(zip(first.tolist(), second.tolist())) == sorted(zip(*np.nonzero(np.triu(near, 1))))


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(15):
            prints.add(p)
            for bit in rng.sample(range(64), rng.randrange(4)):
                p ^= 1 << bit
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    assert sorted((r.a, r.b) for r in got) == expected


# --- 6: token files --------------------------------------------------------------------------

ODD = ["", "x  y\tz", "İstanbul ŉ", "<|endoftext|> hi <|", "ΑΣ Σ", "it's we'LL DON'T '' 12ab_c", "\x1c a \x85 b", "日本語", "a\xadb", "É é ſ ½"]


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(9)
    texts = ODD + [prose(rng, 30) for _ in range(20)]
    import pyarrow as pa

    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(pa.array(texts))]
    assert got == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    rng = random.Random(19)
    pieces = ["a", "'", "'s", "'re", "'LL", "'d", "x1", "22", " ", "\n", "\t ", "!?", "é", "Ü", ".", "s", "ve", "it's", "--'t", "0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(3000)]
    expected = [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(pa.array(texts))] == expected
    long = " ".join(texts)  # in windows
    [raw] = encoder.encode(pa.array([long]), window=500)
    assert np.frombuffer(raw, encoder.dtype).tolist() == encoder.whole.encode(long, add_special_tokens=False).ids


def test_smallest_id_and_null_ids_are_read_back(spark, tables):
    docs = [(-(1 << 63), "least", "en", "s"), (None, "null", "en", "s"), (None, "none", "en", "s"), (0, "x", "en", "s"), ((1 << 63) - 1, "most", "en", "s")]
    rows = sorted(query(6)(spark, tables(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, -(1 << 63), 0, (1 << 63) - 1]


def test_token_files_round_trip(spark, tables):
    rng = random.Random(10)
    docs = [(i * 7 % 101, rng.choice(ODD) + prose(rng, rng.randrange(50)), "en", "s") for i in range(101)]
    rows = sorted(query(6)(spark, tables(docs)).collect())
    library, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    for (i, text, _, _), r in zip(sorted(docs), rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_single_frames_are_read_and_checked(tmp_path):
    import pyarrow as pa

    file = str(tmp_path / "f")
    writer = tokens.FrameWriter(pa.OSFile(file, "wb"))
    for content in (np.array([5, 6], "<u2").tobytes(), np.array([7], "<u2").tobytes(), np.array([0, 9], "<i8").tobytes() + b"\0\1", b"<u2"):
        writer.add(content)
    writer.close()
    reader = tokens.DocumentReader(pa.OSFile(file, "rb"))
    assert [x.tolist() for x in reader.find(9)] == [[7]] and reader.find(4) == reader.find(0) == []
    raw = bytearray(open(file, "rb").read())
    raw[int(reader.frames.starts[1]) + 9] ^= 1
    open(file, "wb").write(raw)
    damaged = tokens.DocumentReader(pa.OSFile(file, "rb"))
    assert damaged.tokens(0).tolist() == [5, 6]
    with pytest.raises(Exception):
        damaged.tokens(1)


# --- 7: licenses -----------------------------------------------------------------------------


def test_licenses(spark, tables):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    docs = [
        (1, "Some words.\nReleased under the MIT license\nMore words."), (2, "a text about a license"), (3, mit.upper().replace(" ", "\n", 40)),
        (4, f"intro\n\n{mit}\n\nend"), (5, "Licensed under CC BY-NC 4.0."),
    ]
    rows = {r.doc_id: r for r in query(7)(spark, tables([(i, t, "en", "s") for i, t in docs])).collect()}
    assert {i: r.licenses for i, r in rows.items()} == {1: "MIT", 2: "", 3: "MIT", 4: "MIT", 5: "CC-BY-NC-4.0"}
    assert rows[1].best_dice == 1.0 and rows[2].n_units == 0


def found_licenses(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [sorted((x.license, round(x.dice, 3)) for x in r.licenses) for r in sorted(rows)]


def test_licenses_within_documents(spark):
    rng = random.Random(13)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    paragraphs = re.sub(r" (The above copyright|THE SOFTWARE IS PROVIDED)", r"\n\n\1", mit)
    wrapped = re.sub(r"(.{40}\S*) ", "\\1\n * ", paragraphs)
    assert paragraphs.count("\n\n") == 2
    texts = [
        f"{prose(rng, 300)}\n\n{paragraphs}\n\n{prose(rng, 400)}", f"/*\n * {wrapped}\n */\nint main() {{}}\n{prose(rng, 300)}", f"{mit}\n{prose(rng, 300)}",
        "Released under the MIT License. Copyright 2021 Jane Doe", "Licensed under CC BY 4.0. See the file of that name, and more.",
        f"{prose(rng, 30)} Released under the MIT License. {prose(rng, 3)} Licensed under CC BY-SA 4.0. {prose(rng, 30)}", f"Of the License and of the Software. {prose(rng, 300)}",
        "This work is licensed under the GNU General Public License, version 3.\n" * 2 + prose(rng, 40),
    ]
    found = found_licenses(spark, texts)
    assert found[0] == [("MIT", 1.0)] and found[1][0][0] == "MIT" and found[1][0][1] > 0.9 and {n for n, _ in found[2]} == {"MIT"}
    assert found[3:6] == [[("MIT", 1.0)], [("CC-BY-4.0", 1.0)], [("CC-BY-SA-4.0", 1.0), ("MIT", 1.0)]]
    assert found[6] == [] and found[7] == [("GPL-3.0", 1.0)] * 2


def test_notices_and_short_texts_are_found(spark):
    """As files with a line of copyright, whole and in the middle of a document, each under its own name only."""
    rng = random.Random(15)
    own = "Copyright (c) 2021, Jane Doe <jane@example.org>\n\n"
    by_name = {n: t for n, t in licenses.NOTICES}
    assert {"ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "Unlicense"} == set(by_name)
    names, texts = [], []
    for name, text in licenses.NOTICES:
        paragraphs = re.sub(r" (THE SOFTWARE IS|THIS SOFTWARE IS|This program is distributed|You should|[123]\\. |Anyone is|In jurisdictions)", r"\n\n\1", text)
        files = [own + paragraphs, f"{prose(rng, 300)}\n{own}{re.sub('(.{50}[^ ]*) ', chr(92) + '1' + chr(10), paragraphs)}\n{prose(rng, 300)}"]
        names += [name] * len(files)
        texts += files
    for name, text, found in zip(names, texts, found_licenses(spark, texts)):
        assert {n for n, _ in found} == {name} and max(d for _, d in found) > 0.9, (name, text, found)


LONG_TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}


@pytest.mark.skipif(not all(os.path.exists(f"/usr/share/common-licenses/{f}") for f in LONG_TEXTS), reason="the texts are not here")
def test_long_texts_are_found_by_the_notice_in_them(spark):
    texts = [open(f"/usr/share/common-licenses/{f}").read() for f in LONG_TEXTS]
    for name, found in zip(LONG_TEXTS.values(), found_licenses(spark, texts)):
        assert name in {n for n, _ in found}, (name, found)


def test_passages_equal_all_windows(spark):
    """Of short texts all windows are tried."""
    rng = random.Random(14)
    template = "a b c d e f g h"

    def pairs(words):
        return set(zip(words, words[1:]))

    own, texts = pairs(template.split()), []
    for _ in range(60):
        words = [w for w in template.split() if rng.random() < 0.9]
        words.insert(rng.randrange(len(words) + 1), "x")
        texts.append(" ".join(rng.choices("abcxyz", k=8) + words + rng.choices("ghxyz", k=8)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licenses.scan(docs, templates=(("L", template),)).collect():
        words = texts[r.doc_id].split()
        windows = [pairs(words[i:j]) for i in range(len(words)) for j in range(i + 2, min(len(words), i + 12) + 1)]
        best = max(2 * len(w & own) / (len(w) + len(own)) for w in windows)
        assert max([x.dice for x in r.licenses], default=0) == pytest.approx(best if best >= 0.75 else 0), texts[r.doc_id]


# --- 8: personal data ------------------------------------------------------------------------

PLAIN_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_personal(text):
    out = []
    for kind, pattern in enumerate(PLAIN_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            passed = (
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15,
            )[kind]
            if passed:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_patterns():
    rng = random.Random(11)
    for _ in range(8000):
        text = "".join(rng.choice("a01.@-+ 2(%é") for _ in range(rng.randrange(45)))
        assert personal_data.pattern_spans(text) == plain_personal(text), text


def test_field_adds_and_keeps(spark, tables):
    docs = [(1, "mail a.b@c.de now, call (415) 555-2671 or +1 (415) 555-2671"), (2, "the license, version 2.0. of 2014"), (3, "card 4111 1111 1111 1111")]
    rows = {r.doc_id: r for r in query(8)(spark, tables([(i, t, "en", "s") for i, t in docs])).collect()}
    assert rows[1].spans == "email:5:13,phone:24:38,phone:42:59" and (rows[1].n_email, rows[1].n_phone) == (1, 1)
    assert rows[2].spans == "" and rows[3].spans == "card:5:24"


def test_decoding_equals_all_paths():
    field = personal_data.trained()
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 0, 3, 5])
    lengths = lengths[lengths > 0]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores = rng.normal(size=(lengths.sum(), len(personal_data.TAGS))).astype(np.float32) * 3
    got = field.decode(scores, starts, lengths)
    import itertools

    for a, n in zip(starts, lengths):
        def value(tags):
            return sum(scores[a + t, k] for t, k in enumerate(tags)) + sum(field.moves[x, y] for x, y in zip(tags, tags[1:]))
        best = max(itertools.product(range(len(personal_data.TAGS)), repeat=int(n)), key=value)
        assert value(tuple(got[a : a + n])) == pytest.approx(value(best), abs=1e-4)


# --- 9 and 10: held-out quality on the given tables ------------------------------------------

SF_DIR = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    import duckdb

    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_DIR}/labels.parquet'").fetchall())
    rows = [r for r in query(9)(spark, SF_DIR).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = ([s for s, t in held if t == v] for v in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.7
    assert np.mean([s >= 0.5 for s in zeros]) < 0.1


def test_toxicity_without_both_classes():
    assert toxicity.score(toxicity.fit([], ["fine"]), "any") == 0.0
    assert toxicity.score(toxicity.fit(["bad"], []), None) == 1.0


def test_languages_on_held_out_rows(spark):
    import duckdb

    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet'").fetchall())
    rows = query(10)(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_training_is_bounded(spark, monkeypatch):
    """Long texts train nothing, too many labels are refused."""
    monkeypatch.setattr(languages, "LONGEST", 20)
    monkeypatch.setattr(toxicity, "LONGEST_TEXT", 20)
    docs = spark.createDataFrame([(1, "short text", "a"), (2, "x " * 50, "a"), (3, "another", "b"), (4, "y " * 90, "c"), (5, None, "d")], "doc_id bigint, text string, lang string")
    assert sorted(tuple(r) for r in languages.training_sample(docs, "doc_id", "lang").select("lang", "text").collect()) == [("a", "short text"), ("b", "another")]
    labels = spark.createDataFrame([(i, int(i in (1, 4))) for i in range(1, 6)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *args: seen.extend(args) or toxicity.Constant(0.0))
    toxicity.train(docs, labels)
    assert seen[0] == ["short text"] and sorted(seen[1], key=str) == [None, "another"] and seen[2:] == [2, 3]
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        languages.training_sample(docs, "doc_id", "lang")


def test_out_of_place_distance():
    model = languages.fit(["abab ba", "xyxy yx"], ["p", "q"])
    assert [r[0] for r in languages.predict(model, ["ab ba", "YX xy", "", None, "12 !", "ж" * 5])] == ["p", "q", "und", "und", "und", "p"]
    assert languages.predict(model, ["abab ba"])[0][2] == 0.0


def test_languages_of_many_scripts_and_lengths(spark):
    """Short texts of small languages beside long ones in other alphabets, and more languages than 256."""
    rng = random.Random(17)
    scripts = {"latin": (0x61, 26, 400), "cyrillic": (0x430, 32, 400), "greek": (0x3B1, 17, 200), "hindi": (0x915, 30, 12), "thai": (0xE01, 40, 12), "korean": (0xAC00, 900, 12), "chinese": (0x4E00, 900, 12)}

    def text(name):
        first, n, words = scripts[name]
        return " ".join("".join(chr(first + min(rng.randrange(n), rng.randrange(n))) for _ in range(rng.randrange(2, 8))) for _ in range(words))

    model = languages.fit([text(n) for n in scripts for _ in range(20)], [n for n in scripts for _ in range(20)])
    assert [languages.predict(model, [text(n)])[0][0] for n in scripts] == list(scripts)

    many = [(i, f"l{i:03}", " ".join(chr(0x4E00 + 20 * i + rng.randrange(20)) for _ in range(50))) for i in range(300)]
    docs = spark.createDataFrame(many, "doc_id bigint, lang string, text string")
    model = languages.train(docs, "doc_id", "lang")
    assert [r[0] for r in languages.predict(model, [t for _, _, t in many])] == [lang for _, lang, _ in many]


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_equals_its_plain_version(spark, tables):
    rng = random.Random(12)
    english, french = [["the", "of", "and", "th"], ["le", "de", "et", "eau"]]
    item = " ".join(rng.choice(WORDS) for _ in range(25))

    def text(words, n):
        return " ".join(rng.choice(words) + rng.choice(WORDS) for _ in range(n))

    docs = []
    for i in range(120):
        words, lang = (english, "en") if i % 3 else (french, "fr")
        docs.append([i, text(words, 40 + i % 17), lang, f"s{i % 4}"])
    docs[50][1] = docs[10][1]
    docs[51][1] = re.sub("[a-z]", lambda m: m[0].upper(), docs[11][1])
    docs[60][1] += " " + item
    docs[70][1] = "12 34 !!"
    docs[71][1] = None
    folder = tables(docs, benchmark=([(1, item)], "item_id bigint, text string"))
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    after = []
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, kept, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        after.append({r.doc_id for r in kept.select("doc_id").collect()})
    everything = set(range(120))
    assert after[0] == everything - {70, 71}
    prints = plain_components({i: plain_fingerprint(docs[i][1]) for i in after[0]})
    assert after[1] == {i for i in after[0] if prints[i] == i} and not {50, 51} & after[1]
    assert after[2] == after[1] - {60}
    assert after[3] <= after[2]
    mixed = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert set(mixed.values()) <= {1, 2}
    library = Tokenizer.from_file(tokens.tokenizer_path())
    out = Counter((r.doc_id, r.n_tokens) for r in run(spark, folder).collect())
    assert out == Counter({(i, len(library.encode(docs[i][1]).ids) + 1): n for i, n in mixed.items()})


def test_clean_rows_of_a_contaminated_id_stay(spark, tables):
    rng = random.Random(16)
    item = prose(rng, 20)
    docs = [(i, prose(rng, 30) + (" " + item if bad else ""), "en", "s") for i, bad in ((None, 1), (None, 0), (5, 0), (5, 1), (6, 0))]
    folder = tables(docs, benchmark=([(1, item)], "item_id bigint, text string"))
    rows = dict(STAGES)["decontamination"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, _, _ in docs if item not in t)
