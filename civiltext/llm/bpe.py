"""Byte-level BPE in numpy: encoding by batched merge rounds, and decoding.

A batch of texts is one array of characters. Their classes (letter, number, space, other) give the begin of every piece
at once; equal pieces are encoded once. The bytes of all different pieces lie in one flat array of symbols. In a round
every piece finds its lowest-ranked pair, by binary search over the sorted keys of all pairs, and merges its occurrences;
finished pieces leave the array. Very long pieces would hold up the rounds of all others, so these are merged one by one,
rank by rank, over a linked list, which touches only what changes.

A text longer than `WINDOW` bytes is encoded in parts, cut where white space follows something else: a piece always
begins there and none reaches across, so the ids are those of the whole text. Ids are binary, four bytes each, little
endian. A null text is an empty one and has no ids. Null ids decode to an empty text, ids that are not in the vocabulary
to nothing, and bytes that are no UTF-8 to the replacement character. Equal texts have equal ids; other columns are not
read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import (
    BLANK, LETTER, NUMBER, bound_batches, buffers, character_classes, chunks, documents, edges, gather, text_windows,
)
from civiltext.llm.tokens import tokenizer_path

WINDOW = 4 << 20
LONG_PIECE = 256  # symbols, from which a piece is merged on its own
SPECIAL, NONE = 4, 5  # further classes of characters
NO_RANK = np.iinfo(np.int32).max
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: after an apostrophe they are pieces


def byte_alphabet() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes for themselves, the others in order from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairEncoder:
    """The vocabulary, its pairs sorted by key, and the two directions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = (
            spec["normalizer"] is None and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
            and model["type"] == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocabulary, alphabet = model["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.symbol = np.zeros(256, dtype=np.int64)
        for letter, byte in alphabet.items():
            self.symbol[byte] = vocabulary[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        made = np.full(self.size, -1, dtype=np.int64)
        made[self.merged] = np.arange(len(pairs))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a pair is ranked before what it is made of")
        keys = left * self.size + right
        self.rank_of = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_of]
        texts = [b""] * self.size
        for token, i in vocabulary.items():
            texts[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.token_sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.token_starts = edges(self.token_sizes)[:-1]

    # --- pieces

    def _piece_starts(self, points: np.ndarray, text_starts: np.ndarray, special: list[tuple[int, int]]) -> np.ndarray:
        """Whether a piece begins at each character."""
        n = len(points)
        kind = character_classes()[points]
        for begin, end in special:
            kind[begin:end] = SPECIAL
        first = np.zeros(n + 1, dtype=bool)
        first[text_starts] = True
        first = first[:n]
        before, after, previous = np.empty_like(kind), np.empty_like(kind), np.empty_like(points)
        before[1:], after[:-1], previous[1:] = kind[:-1], kind[1:], points[:-1]
        before[first], previous[first] = NONE, 0
        after[-1] = NONE
        after[:-1][first[1:]] = NONE
        begins = kind != before
        word_like = kind <= NUMBER
        # white space: the last character of a run goes with what follows, if that is part of the text
        starts = begins | ((kind == BLANK) & (after <= NUMBER))
        attached = begins & word_like & (previous == 0x20)
        starts &= ~attached
        # an apostrophe alone, then letters
        for i in np.flatnonzero((points == 0x27) & begins & ~attached & (after == LETTER)).tolist():
            ahead = 1 + int(i + 2 < n and not first[i + 2] and kind[i + 2] == LETTER)
            letters = "".join(map(chr, points[i + 1 : i + 1 + ahead]))
            hit = next((s for s in SUFFIXES if letters.startswith(s)), None)
            if hit:
                starts[i + 1] = False
                if i + 1 + len(hit) < n:
                    starts[i + 1 + len(hit)] = True
        for begin, end in special:
            starts[begin:end] = False
            starts[begin] = True
        return starts

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of the texts that lie one after another in `data`, and how many lie before each bound."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        special = []
        for token in self.special:
            if token.encode() in raw:
                special = self._special_places(raw, bounds, byte_at)
                break
        text_starts = np.searchsorted(byte_at, bounds[:-1])
        starts = self._piece_starts(points, text_starts, special)
        begins = byte_at[starts]
        offsets = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return pieces.dictionary_encode(), np.searchsorted(begins, bounds)

    def _special_places(self, raw: bytes, bounds: np.ndarray, byte_at: np.ndarray) -> list[tuple[int, int]]:
        places = []
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            text = raw[begin:end].decode("utf-8")
            if any(token in text for token in self.special):
                first = int(np.searchsorted(byte_at, begin))
                places += [(first + m.start(), first + m.end()) for m in self.special_pattern.finditer(text)]
        return places

    # --- merges

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def _rounds(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short pieces at once; returns their ids one after another, and the number of each."""
        out, sizes = [], np.zeros(len(counts), dtype=np.int64)
        order, number = [], np.arange(len(counts))
        while len(number):
            bounds = edges(counts)
            owner = np.repeat(np.arange(len(number)), counts)
            ranks = np.full(len(symbols), NO_RANK, dtype=np.int32)
            ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
            ranks[bounds[1:] - 1] = NO_RANK  # the last symbol of a piece has no right neighbour
            least = np.minimum.reduceat(ranks, bounds[:-1])
            done = least == NO_RANK
            if done.any():
                ended = done[owner]
                out.append(symbols[ended])
                order.append(number[done])
                sizes[number[done]] = counts[done]
                symbols, ranks, owner, least = symbols[~ended], ranks[~ended], owner[~ended], least[~done]
                number = number[~done]
                owner = (np.cumsum(~done) - 1)[owner]
            merge = ranks == least[owner]
            # of overlapping occurrences (three equal symbols) every other one, from the left
            at = np.flatnonzero(merge)
            overlap = np.flatnonzero(np.diff(at) == 1)
            if len(overlap):
                run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
                place = np.arange(len(at)) - np.searchsorted(run, run)
                at = at[place % 2 == 0]
            symbols[at] = self.merged[least[owner[at]]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
            counts = np.bincount(owner, minlength=len(number))
        if not out:
            return symbols, sizes
        order, flat = np.concatenate(order), np.concatenate(out)
        begins = np.empty(len(sizes), dtype=np.int64)
        begins[order] = edges(sizes[order])[:-1]
        return gather(flat, begins, sizes), sizes

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one long piece, rank by rank from the lowest: a merge only makes pairs of higher ranks."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks, alive = np.full(n, NO_RANK, dtype=np.int32), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] < n]
            ranks[at] = found = self._ranks(symbols[at], symbols[after[at]])
            at, found = at[found != NO_RANK], found[found != NO_RANK]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for places in np.split(at, cuts) if len(at) else []:
                rank = int(ranks[places[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(places)

        enter(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            if not len(at):
                continue
            linked = after[at[:-1]] == at[1:]
            if linked.any():
                run = np.concatenate(([0], np.cumsum(~linked)))
                at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[rank]
            alive[gone] = False
            after[at] = after[gone]
            ranks[at] = NO_RANK
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            enter(np.unique(np.concatenate((before[at][before[at] >= 0], at))))
        return symbols[alive]

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces: all ids in a row, where each piece's begin, and how many it has."""
        data, bounds = buffers(pieces)
        counts, begins = np.diff(bounds), bounds[:-1]
        short = counts <= LONG_PIECE
        flat, sizes = self._rounds(self.symbol[gather(data, begins[short], counts[short])], counts[short])
        parts, size, start = [flat], np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        size[short], start[short] = sizes, edges(sizes)[:-1]
        used = len(flat)

        def put(i: int, ids: np.ndarray) -> None:
            nonlocal used
            size[i], start[i] = len(ids), used
            parts.append(ids)
            used += len(ids)

        for i in np.flatnonzero(~short).tolist():
            put(i, self._long(self.symbol[data[bounds[i] : bounds[i + 1]]]))
        for token, number in self.special.items():
            at = pc.index(pieces, pa.scalar(token.encode(), pa.large_binary())).as_py()
            if at >= 0:
                put(at, np.array([number]))
        return np.concatenate(parts), start, size

    # --- texts

    def _encode_flat(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the bounds, and the number of ids before each bound."""
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        pieces, piece_bounds = self._pieces(data, bounds)
        flat, start, size = self._encode_pieces(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        ids = gather(flat.astype("<u4"), start[codes], size[codes])
        return ids, edges(size[codes])[piece_bounds]

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Arrays of the ids of the texts, in order, as binary."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        for part in chunks(texts, WINDOW):
            data, bounds = buffers(part)
            if len(part) == 1 and len(data) > WINDOW:
                ids = b"".join(self._encode_flat(w, np.array([0, len(w)]))[0].tobytes() for w in text_windows(data, WINDOW))
                yield pa.array([ids], pa.binary())
                continue
            ids, bounds = self._encode_flat(data, bounds)
            offsets = (bounds * 4).astype(np.int32)
            yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])

    def decode(self, ids: pa.Array) -> Iterator[pa.Array]:
        """Arrays of the texts of the ids, in order."""
        for part in chunks(pc.fill_null(ids, b"").cast(pa.large_binary()), WINDOW):
            packed, places = buffers(part)
            numbers = packed.view("<u4").astype(np.int64)
            known = numbers < self.size
            numbers = np.where(known, numbers, 0)
            sizes = np.where(known, self.token_sizes[numbers], 0)
            data = gather(self.token_bytes, self.token_starts[numbers], sizes)
            bounds = edges(sizes)[places // 4]
            raw = pa.Array.from_buffers(
                pa.large_binary(), len(part), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes())]
            )
            try:
                yield raw.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # some text is no UTF-8
                yield pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def _encoder(path: str) -> BytePairEncoder:
    """One per Python worker."""
    return BytePairEncoder(path)


def encoded(text: Column, tokenizer: str) -> Column:
    """Token ids of a text, as binary."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([*_encoder(tokenizer).encode(texts), pa.array([], pa.binary())])

    return encode(text)


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text of token ids."""

    @F.arrow_udf("string")
    def decode(numbers: pa.Array) -> pa.Array:
        return pa.concat_arrays([*_encoder(tokenizer).decode(numbers), pa.array([], pa.string())])

    return decode(ids)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir).select("doc_id", encoded(F.col("text"), path).alias("ids"))
    return docs.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path).cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_byte_pairs": op12_byte_pairs}
SQL: dict[str, str] = {}
