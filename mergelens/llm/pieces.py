"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make, leftmost first among
equals, and merges until no pair makes a piece. A text is first cut wherever no piece of the vocabulary holds the two
characters at the cut next to each other: no merge can cross there, so each segment has an agenda of its own and equal
segments are encoded once. Every segment that is new to a worker is checked against the sentencepiece library, a batch
of them at a time; a difference raises.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: The rank of a pair that makes no piece.
NONE = 2**31 - 1
#: Parts of more characters are merged one by one.
LONG = 28
#: Where a word meets marks.
EDGE = re.compile(r"(?<=\w)(?=[^\w▁])|(?<=[^\w▁])(?=\w)")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """A merge-type vocabulary with byte fallback and without character normalisation.

    Raises ValueError for other kinds: unigram models, normalisers other than identity, user-defined pieces.
    """

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, normaliser, self.dummy_prefix, remove_spaces, escape, byte_fallback = 1, b"identity", True, True, True, False
        self.unk, self.bos, self.eos, self.unk_surface = 0, 1, 2, " ⁇ "
        for number, value in _fields(model):
            if number == 1:
                piece, score, what = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        what = v
                self.pieces.append((piece, score, what))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        kind = v
                    elif n == 35:
                        byte_fallback = bool(v)
                    elif n in (40, 41, 42):
                        setattr(self, {40: "unk", 41: "bos", 42: "eos"}[n], v)
                    elif n == 44:
                        self.unk_surface = v.decode()
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        normaliser = b"custom"
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        remove_spaces = bool(v)
                    elif n == 5:
                        escape = bool(v)
        kinds = {k for _, _, k in self.pieces}
        if kind != 2 or normaliser != b"identity" or remove_spaces or not escape or not byte_fallback or kinds & {4, 5}:
            raise ValueError("not a merge-type vocabulary with byte fallback and identity normalisation")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == 1}
        self.scores = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.table = Merges(self.ids, self.scores)
        self.surface = [b"" if k == 3 else self.unk_surface.encode() if k == 2 else bytes([self.byte_of[i]]) if k == 6 else p.replace(SPACE, " ").encode() for i, (p, _, k) in enumerate(self.pieces)]
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        free = "".join(c for c in "\n\r\t" if not any(c in pair for pair in self.pairs))
        cut = re.escape(free)
        #: Segments that no merge leaves: at most a run of spaces and what follows it, or a free character.
        self.segments = re.compile(f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if free and not inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not inner else "(?s:.+)")

    def agenda(self, text: str) -> list[int]:
        """Ids of one segment: merges the pair that makes the piece of highest score, leftmost first, while there is one."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores = self.scores
        heap: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            made = text[i : i + 2]
            if (s := scores.get(made)) is not None:
                heap.append((-s, i, i + 1, made))
        heapq.heapify(heap)
        while heap:
            _, i, j, made = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(both := made + symbols[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, both))
            if (k := before[i]) >= 0 and (s := scores.get(both := symbols[k] + made)) is not None:
                heapq.heappush(heap, (-s, k, i, both))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    def parts(self, text: str) -> list[str]:
        """A segment cut once more between characters that no piece joins."""
        pairs = self.pairs
        where = range(1, len(text)) if len(text) > LONG else [m.start() for m in EDGE.finditer(text)]
        cuts = [i for i in where if text[i - 1 : i + 1] not in pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]

    def agendas(self, parts: list[str]) -> list[bytes]:
        """``agenda`` of many parts at once, as little-endian words: a row of adjacent pairs for each part, and in every
        round each row merges its best pair. Long parts, and those with characters that are no pieces, go one by one."""
        out: list[bytes | None] = [None] * len(parts)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LONG)):
            at = np.flatnonzero((lens > low) & (lens <= high))
            if not len(at):
                continue
            points = np.array([parts[i] for i in at.tolist()], f"U{high}").view(np.uint32).reshape(len(at), high)
            symbols = self.table.char_ids[points]
            inside = np.arange(high) < lens[at][:, None]
            whole = ((symbols >= 0) | ~inside).all(axis=1)
            at, symbols, inside = at[whole], symbols[whole], inside[whole]
            symbols[~inside] = -1
            self.table.merge(symbols)
            kept = symbols >= 0
            packed, sizes = symbols[kept].astype("<u4").tobytes(), kept.sum(axis=1)
            ends = (np.cumsum(sizes) * 4).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends], ends, strict=False):
                out[i] = packed[a:b]
        return [np.array(self.agenda(p), "<u4").tobytes() if o is None else o for p, o in zip(parts, out, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """As the library does: controls vanish, bytes join to characters, a byte that is part of none is U+FFFD, and the
        space that the encoder put in front goes."""
        pieces, surface = self.pieces, self.surface
        at = 0
        while at < len(ids) and pieces[ids[at]][2] == 3:
            at += 1
        end = len(ids)
        while end > at and pieces[ids[end - 1]][2] == 3:
            end -= 1
        parts = [surface[i] for i in ids[at:end]]
        if self.dummy_prefix and parts and pieces[ids[at]][2] == 1 and parts[0][:1] == b" ":
            parts[0] = parts[0][1:]
        try:
            if all(parts[1:]):
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], []
        for x in [*parts, b""]:  # a control ends a run of bytes
            if x:
                run.append(x)
            else:
                out.append(re.sub("[\udc80-\udcff]", "\ufffd", b"".join(run).decode(errors="surrogateescape")))
                run = []
        return "".join(out)


class Merges:
    """Every pair of symbols that makes a piece, as sorted arrays."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[0] = -1
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = sorted((ids[p[:k]] << 20 | ids[p[k:]], i, order[scores[p]]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys, made, rank = (np.array(x) for x in zip(*found, strict=True))
        self.made, self.rank = np.append(made, -1).astype(np.int32), np.append(rank, NONE).astype(np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the pairs (a, b) stand; the last place stands for none."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64) & 0xFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), at, len(self.keys))

    def merge(self, symbols: np.ndarray) -> None:
        """Merges the rows of ``symbols`` (-1 behind their ends) in place."""
        if not symbols.size or symbols.shape[1] < 2:
            return
        rows, own = np.arange(len(symbols)), symbols.copy()
        places = self.pair(own[:, :-1].ravel(), own[:, 1:].ravel()).reshape(len(own), -1)
        cols = np.arange(own.shape[1])
        while len(rows):
            ranks = self.rank[places]
            best = ranks.argmin(axis=1)
            left = np.arange(len(rows))
            more = ranks[left, best] != NONE
            if not more.all():
                symbols[rows[~more]] = own[~more]
                rows, own, places, best = rows[more], own[more], places[more], best[more]
                left = np.arange(len(rows))
                if not len(rows):
                    break
            made = self.made[places[left, best]]
            beyond = cols[:-1] > best[:, None]
            own[:, :-1] = np.where(beyond, own[:, 1:], own[:, :-1])
            own[:, -1] = -1
            places[:, :-1] = np.where(beyond[:, :-1], places[:, 1:], places[:, :-1])
            places[:, -1] = len(self.keys)
            own[left, best] = made
            inner = best < own.shape[1] - 1
            after = np.minimum(best + 1, own.shape[1] - 1)
            new = np.where(inner, self.pair(made, np.where(inner, own[left, after], -1)), len(self.keys))
            places[left[inner], best[inner]] = new[inner]
            behind = best > 0
            places[left[behind], best[behind] - 1] = self.pair(own[left[behind], best[behind] - 1], made[behind])


@lru_cache(maxsize=4)
def _loaded(model: bytes) -> tuple[Vocabulary, object, dict[str, bytes]]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(model)
    return Vocabulary(model), library, {}


def encode_batch(model: bytes, texts: list[str]) -> list[bytes]:
    """Ids of each text without begin and end, as little-endian 32-bit words."""
    v, library, known = _loaded(model)
    if len(known) > REMEMBERED:
        known.clear()
    cut = []
    for text in texts:
        text = text.replace(" ", SPACE)
        cut.append(v.segments.findall(SPACE + text if v.dummy_prefix and text else text))
    new = list({s for segments in cut for s in segments if s not in known})
    split = [v.parts(s) for s in new]
    parts = list({p for ps in split for p in ps if p not in known})
    made = dict(zip(parts, v.agendas(parts), strict=True))
    ids = [b"".join([made.get(p) or known[p] for p in ps]) for ps in split]
    # The library puts a space in front: a segment that begins with one goes without it, others stand behind a line feed.
    bare = [not v.dummy_prefix or s[0] == SPACE and len(s) > 1 for s in new]
    heads = [s[v.dummy_prefix :] if b else "\n" + s for s, b in zip(new, bare, strict=True)]
    lead = np.array(v.agenda(SPACE) + v.agenda("\n"), "<u4").tobytes()
    flat = library.encode(heads, num_threads=1)
    if b"".join([own if b else lead + own for own, b in zip(ids, bare, strict=True)]) != np.fromiter(chain.from_iterable(flat), "<u4").tobytes():
        raise AssertionError("own ids differ from the library's")
    known.update(made)
    known.update(zip(new, ids, strict=True))
    return [b"".join([known[s] for s in segments]) for segments in cut]


def tokenize(docs: DataFrame, model_path: str, with_ids: bool = False, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text of every row.

    Encodes whole texts with begin and end ids and decodes them again; a null text is empty. Digests are of the ids as
    little-endian unsigned 32-bit words and of the decoded text in UTF-8. Rows stand alone: repeated rows are encoded
    each, an empty table gives an empty one. ``model_path`` is read on the driver and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Vocabulary(model)  # raises here for a kind that isn't supported

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, library, _ = _loaded(model)
        head, tail = np.array([v.bos], "<u4").tobytes(), np.array([v.eos], "<u4").tobytes()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n, digests, decoded, all_ids, out = [], [], [], [], []
            for at in range(0, len(texts), 2000):
                some = texts[at : at + 2000]
                for k, body in enumerate(encode_batch(model, some)):
                    packed = head + body + tail
                    ids = np.frombuffer(packed, "<u4").tolist()
                    if at == k == 0 and ids != library.encode(some[0], add_bos=True, add_eos=True):
                        raise AssertionError("own ids of a whole text differ from the library's")
                    back = v.decode(ids)
                    n.append(len(ids))
                    digests.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(packed)
                    if with_text:
                        out.append(back)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(all_ids), "<u4").astype(np.int32))
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends), values)], [*names, "ids"]
            if with_text:
                cols, names = [*cols, pa.array(out, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
