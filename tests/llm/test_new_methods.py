"""Hard negatives, byte pairs and the prefix trie against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from civiltext.llm import bpe, hard_negatives, prefix_trie
from civiltext.llm.common import stored
from civiltext.llm.queries import QUERIES
from civiltext.llm.tokens import tokenizer_path

QUERY = {n: next(f for name, f in QUERIES.items() if name.startswith(f"op{n}_")) for n in (11, 12, 13)}
VECTORS = "vec_id bigint, embedding array<float>, label int, uid string, vector string, id string, score int"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, conv string, k1 int"


# --- 11: hard negatives ----------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=10):
    taking = []
    for number, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        taking.append((number, i, [int(np.floor(256.0 * float(np.float32(x)))) for x in vector], label))
    out = []
    for number, i, v, label in taking:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, other == label) for n, j, w, other in taking if n != number]
        scored.sort(key=lambda r: r[:3])
        for s, _, _, p, _ in [r for r in scored if r[4]][:positives]:
            fit = [r for r in scored if not r[4] and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(i, p, rank, r[3], -s, -r[0]) for rank, r in enumerate(fit, 1)]
    return out


def mined(spark, folder):
    rows = QUERY[11](spark, folder).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows), key=str)


def vectors_in(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], VECTORS)
    frame.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def near_vectors(rng, n, width, copies=0):
    centres = rng.normal(0, 0.2, (6, width))
    rows = []
    for k in range(n):
        label = int(rng.integers(0, 4))
        rows.append((k, (centres[rng.integers(0, 6)] + rng.normal(0, 0.1, width)).astype("f4").tolist(), label))
    return rows + [(n + k, rows[5][1], int(k % 3)) for k in range(copies)]


@pytest.mark.parametrize("width", [1, 7, 64])
def test_negatives_equal_the_plain_search(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)  # many blocks
    rows = near_vectors(np.random.default_rng(width), 420, width, copies=90)
    assert mined(spark, vectors_in(spark, tmp_path, rows)) == sorted(plain_negatives(rows), key=str)


def test_negatives_of_odd_rows(spark, tmp_path):
    v = [0.5, 0.25, -0.125]
    rows = [
        (0, v, 1), (0, v, 1), (100, v, None), (200, None, 1), (300, [0.5, None, 1.0], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf")], 1),
        (None, v, 1), (None, [0.5], 2), (None, [0.4, 0.1, 0.0], 2), (3, [0.3], 2), (4, [0.3, 0.0, 0.0, 0.0, 9.0], 2), (600, [], 3), (601, [], 3),
        (602, [1.0], 4), (1100, [-0.5], 5), (1101, [0.5], 5), (1102, [-0.1], 6), (3, [0.3], 2), (100000, [1e20, 1.0], 8), (100001, [1e20], 8), (100002, [5e19, 1.0], 9),
    ]
    found = mined(spark, vectors_in(spark, tmp_path, rows))
    large = hard_negatives.LARGEST
    expected = [(a, p, rank, n, min(max(s, -large), large), min(max(t, -large), large)) for a, p, rank, n, s, t in plain_negatives(rows) if a != 100000]
    assert [r for r in found if r[0] != 100000] == sorted(expected, key=str)
    # both beyond the range of a long: the window holds no equal score
    assert not [r for r in found if r[0] == 100000]


def test_no_vectors(spark, tmp_path):
    assert mined(spark, vectors_in(spark, tmp_path, [])) == []
    assert QUERY[11](spark, str(tmp_path)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (8, 64))
    rows = np.floor(centres[rng.integers(0, 8, 500)] + rng.normal(0, 3, (500, 64)))
    exact, (mean, dev), column, widths = rows @ rows.T, hard_negatives.summaries(rows), 0, []
    for edges in hard_negatives.segment_edges(64):
        level = slice(column, column + len(edges))
        column += len(edges)
        middle, spread = mean[:, level] @ mean[:, level].T, dev[:, level] @ dev[:, level].T
        assert (middle - spread - 1e-6 <= exact).all() and (exact <= middle + spread + 1e-6).all()
        widths.append(spread.mean())
    assert column == mean.shape[1] and widths == sorted(widths, reverse=True) and widths[-1] < 0.75 * widths[0]


# --- 12: byte pairs --------------------------------------------------------------------------

PIECES = [
    "a", "b", "s", "t", "'", "'s", "'re", "'ll", "'ve", "'D", " ", "  ", "\n", "\r\n", "\t", "1", "23", "²", ".", "!!", "é", "é", "中文", "\xa0",
    "　", "<|endoftext|>", "<|end", "I'm", "don't", "X", "😀", "_", "\x1c", "\x85", "​", "re", "ll", "ß", "ĳ", " ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder(tokenizer_path("byte_bpe_50k.json"))


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for part in encoder.encode(pa.array(texts, pa.string())) for x in part.to_pylist()]


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(4000)]
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_of_all_characters(library, encoder):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["a" + "".join(f"{c}b" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_and_long_texts(library, encoder, monkeypatch):
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdeé") for _ in range(60_000))
    texts = ["a" * 100_001, letters, "ab" * 4000 + "aaab" * 3000, "-" * 7000 + "=" * 999, "", " " * 5000, "\n" * 999 + "x"]
    texts.append(" ".join("".join(rng.choice(PIECES) for _ in range(30)) for _ in range(3000)))
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == expected
    monkeypatch.setattr(bpe, "WINDOW", 1000)
    assert ids_of(encoder, texts) == expected


def test_both_ways_of_merging_agree(encoder, monkeypatch):
    rng = random.Random(5)
    texts = [" " + "".join(rng.choice("aabrest-=é") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    rounds = ids_of(encoder, texts)
    monkeypatch.setattr(bpe, "LONG_PIECE", 0)
    assert ids_of(encoder, texts) == rounds


def test_decoding(library, encoder):
    rng = random.Random(6)
    numbers = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(300)] + [[], [50_256, 50_256], [60_000, 220, 4_000_000_000]]
    packed = pa.array([np.array(n, "<u4").tobytes() for n in numbers] + [None], pa.binary())
    texts = [x for part in encoder.decode(packed) for x in part.to_pylist()]
    assert texts == [library.decode(n, skip_special_tokens=False) for n in numbers] + [""]


def test_byte_pair_query(spark, tables, library):
    rng = random.Random(7)
    texts = ["", None, "same", "same", "x" * 50_000, *("".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(200))]
    folder = tables([(k, t, "en", "s") for k, t in enumerate(texts)])
    rows = {r.doc_id: r for r in QUERY[12](spark, folder).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.BytePairEncoder(tokenizer_path("word_bpe_49k.json"))


# --- 13: prefix trie -------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c, steps in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + steps[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((
        (cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, cs in members.items()), key=str)


def trie_of(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "x", 1) for r in rows], TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted(map(tuple, QUERY[13](spark, str(tmp_path)).collect()), key=str)


def dialogues(rng, convs, most=9):
    rows = []
    for c in convs:
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["yes", "no", "é𝄞", ""])) for t in range(rng.randrange(1, most))]
    return rows


def test_trie_equals_the_plain_one(spark, tmp_path):
    rng = random.Random(8)
    rows = dialogues(rng, [*range(0, 130), *range(300, 420), *range(-130, -60), 10**15])
    rows += [(500 + k, t, "user", f"turn {t}") for k in range(60) for t in range(8)]  # many equal ones
    rows += [(100, None, None, None), (101, 3, None, "x")]
    assert trie_of(spark, tmp_path, rows) == plain_trie(rows)


@pytest.mark.parametrize("cells, chunk", [(2, 3), (1 << 12, 2)])
def test_trie_with_collisions_and_small_chunks(spark, tmp_path, monkeypatch, cells, chunk):
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", chunk)
    rows = dialogues(random.Random(9), range(0, 90), most=14)
    assert trie_of(spark, tmp_path, rows) == plain_trie(rows)


def test_trie_of_a_conversation_over_many_parts(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t % 50}") for c in (0, 1) for t in range(600)] + [(2, 0, "user", "alone")]
    assert trie_of(spark, tmp_path, rows) == plain_trie(rows)


def test_repeated_turns_count_each(spark, tmp_path):
    rows = [(0, 1, "user", "a")] * 9 + [(1, 1, "user", "a")] * 9 + [(None, 1, "user", "a")]
    assert trie_of(spark, tmp_path, rows) == plain_trie(rows)


def test_no_conversations(spark, tmp_path):
    assert trie_of(spark, tmp_path, []) == []


def test_sketch_never_counts_too_little(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, (300, 2))
    repeated = np.concatenate((keys, keys[:100], keys[:40]))
    frame = stored(spark.createDataFrame([(int(a), int(b)) for a, b in repeated], "k1 bigint, k2 bigint").repartition(4), "keys")
    for width in (16, 1 << 14):
        sketch = prefix_trie.count_min(frame, width)
        cells = prefix_trie._cells(keys[:, 0], keys[:, 1], width)
        estimate = np.minimum.reduce([row[c] for row, c in zip(sketch, cells)])
        assert (estimate[:100] == 2).all() and (estimate >= 1).all()
    assert (estimate[100:] == 1).mean() > 0.99
