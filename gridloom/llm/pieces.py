"""SentencePiece encoding and decoding with forward states shared over a trie of words."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, returning

#: Words whose pieces, and pairs of pieces whose verdict, a generation of a worker's memory holds at most; it keeps two.
CACHE_WORDS, CACHE_PAIRS = 300_000, 400_000
#: Bytes of texts (one at least) whose words are cut, and share a trie, at once.
TEXTS = 8 << 20
MARK = "▁"
#: Within this module marks are spaces: most words are then ASCII strings.
SPACE = " "
#: Field numbers of the public model format.
_TRAINER, _NORMALIZER, _PIECE = 2, 3, 1
_UNIGRAM, _BPE = 1, 2
#: Characters of a word that are compared at once.
_HEAD = 24


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield number, raw[at : at + n]
            at += n


class Encoder:
    """A model's pieces, and the forward pass over marked words.

    In a BPE model the state of a prefix is the last piece of its encoding:
    a sequence of pieces is the encoding of its text exactly if each two
    neighbours are the encoding of theirs, and a prefix that ends between
    pieces is encoded as within the whole. So the last piece at a position is
    the one whose text ends there and which stands beside the last piece
    where it begins. In a unigram model the state is the best score and the
    piece that it ends with, as in Viterbi's algorithm. Either state depends
    on the prefix alone: words in sorted order share it for what they begin
    with alike.
    """

    def __init__(self, model: bytes) -> None:
        self.model = model
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.processor
        trainer = dict(_fields(b"".join(v for k, v in _fields(model) if k == _TRAINER)))
        normal = dict(_fields(b"".join(v for k, v in _fields(model) if k == _NORMALIZER)))
        self.kind = trainer.get(3, _UNIGRAM)
        self.dummy, self.tidy, self.escape = (normal.get(k, 1) for k in (3, 4, 5))
        if normal.get(2, b"") or self.tidy or not self.escape or trainer.get(24, 0):
            raise ValueError("only models with the identity normalisation, white space kept and marked in front are taken")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are taken")
        ids = range(p.get_piece_size())
        own = {p.id_to_piece(i): i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        if any(SPACE in t for t in own):
            raise ValueError("a piece holds a space")
        self.ids = {t.replace(MARK, SPACE): i for t, i in own.items()}
        self.score = {t: p.get_score(i) for t, i in self.ids.items()}
        text = [p.id_to_piece(i) for i in ids]
        self.bytes = {int(text[i][3:5], 16): i for i in ids if p.is_byte(i)}
        self.unknown = p.unk_id()
        inner = [t for t in self.ids if len(t) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in inner):
            raise ValueError("a piece goes over the start of a word")
        # a character in no longer piece stands alone: text may be parted at both of its sides
        alive = "".join(re.escape(c) for c in sorted(set("".join(inner)) - {SPACE}))
        self.words = re.compile(f"{SPACE}*[{alive}]+|{SPACE}+|[^{alive}{SPACE}]" if alive else f"{SPACE}+|[^{SPACE}]", re.S)
        value = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([value[i]]) if i in value else t.replace(MARK, SPACE).encode("utf-8") for i, t in enumerate(text)]
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.build()

    def build(self) -> None:
        """The automaton of the pieces: after each prefix of a word, which longer pieces end there, the longest first."""
        inner = [t for t in self.ids if len(t) > 1]
        nodes = sorted({t[:k] for t in inner for k in range(len(t) + 1)} | {""}, key=len)
        at = {t: i for i, t in enumerate(nodes)}
        self.step: list[dict[str, int]] = [{} for _ in nodes]
        for t in nodes[1:]:
            self.step[at[t[:-1]]][t[-1]] = at[t]
        # where a node's text goes on without its first characters, as far as some piece begins so
        self.fall = [0] * len(nodes)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(nodes)
        for i, t in enumerate(nodes):
            if i:
                self.fall[i] = self.follow(self.fall[at[t[:-1]]], t[-1]) if len(t) > 1 else 0
                self.ends[i] = (((self.ids[t], len(t)),) if len(t) > 1 and t in self.ids else ()) + self.ends[self.fall[i]]

    def follow(self, node: int, c: str) -> int:
        """The automaton's next node; remembered for the characters of pieces."""
        seen = []
        while (to := self.step[node].get(c)) is None and node:
            seen.append(node)
            node = self.fall[node]
        if to is None:
            return 0
        for n in seen:
            self.step[n][c] = to
        return to

    def marked(self, text: str) -> str:
        text = text.replace(MARK, SPACE)
        return SPACE + text if self.dummy and text else text

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by BPE: the best-scoring merge of neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, key: int, a: str, b: str) -> bool:
        """Whether two pieces, or one after nothing, are the encoding of their text; remembered under ``key``."""
        known = self.old_pairs.get(key)
        if known is None:
            known = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.pairs) >= CACHE_PAIRS:
            self.old_pairs = dict(self.pairs)
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct marked words (as 32-bit numbers), by a depth-first walk of their trie.

        Sorted words are the trie in depth-first order: what a word begins
        with as the one before it keeps its forward states: the last piece
        and where it begins, the score, the ids so far, and the place in the
        automaton of the pieces.
        """
        order = sorted(words)
        out: dict[str, bytes] = {}
        beyond, bpe = 1 << 22, self.kind == _BPE
        room = max(map(len, order), default=0) + 1
        # a character without a piece has its code beyond all ids for a number
        number, start, total, node, done = [1 << 24] * room, [0] * room, [0.0] * room, [0] * room, [b""] * room
        ids, step, ends, pairs, follow, beside = self.ids, self.step, self.ends, self.pairs, self.follow, self.beside
        packed = {i: array("i", [i]).tobytes() for i in ids.values()}
        scores = {i: self.score[t] for t, i in ids.items()}
        for word, same in zip(order, shared_prefixes(order), strict=True):
            state, end = node[same], same
            for c in word[same:]:
                begin, end = end, end + 1
                state = step[state].get(c) or follow(state, c)
                node[end] = state
                if bpe:
                    for piece, n in ends[state]:  # the longest first
                        a = end - n
                        key = number[a] << 25 | piece
                        known = pairs.get(key)
                        if known if known is not None else beside(key, word[start[a] : a], word[a:end]):
                            number[end], start[end], done[end] = piece, a, done[a] + packed[piece]
                            break  # no other piece fits
                    else:
                        piece = ids.get(c)
                        number[end], start[end] = beyond + ord(c) if piece is None else piece, begin
                        done[end] = done[begin] + (array("i", self.of(c)).tobytes() if piece is None else packed[piece])
                    continue
                piece, a = ids.get(c), begin
                best = total[begin] + scores.get(piece, self.least)
                for longer, n in ends[state]:
                    s = total[end - n] + scores[longer]
                    if s > best or (s == best and a == begin):  # the longest of equals
                        best, piece, a = s, longer, end - n
                total[end], done[end] = best, done[a] + (array("i", self.of(c)).tobytes() if piece is None else packed[piece])
            out[word] = done[end]
        return out

    def of(self, piece: str) -> list[int]:
        """Ids of a piece: its own, or its bytes', or the unknown one."""
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of whole texts; None for None."""
        split = [None if t is None else self.words.findall(self.marked(t)) for t in texts]
        need: set[str] = set()
        for ws in split:
            if ws:
                need.update(ws)
        fresh = need.difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
            fresh = need
        known = fresh & self.old.keys()
        self.cache |= {w: self.old[w] for w in known}
        self.cache |= self.encode_words(fresh - known)
        cache = self.cache
        return [None if ws is None else np.frombuffer(b"".join(map(cache.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: pieces joined, runs of byte pieces as UTF-8, marks as spaces, without the leading mark."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def shared_prefixes(order: list[str]) -> list[int]:
    """How many characters each of the sorted words begins with as the one before it."""
    out: list[int] = []
    for k in range(0, len(order), 1 << 16):
        some = order[max(0, k - 1) : k + (1 << 16)]
        cut = np.array([w[:_HEAD] for w in some], f"U{_HEAD}").view(np.uint32).reshape(len(some), _HEAD)
        differs = cut[1:] != cut[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), _HEAD).tolist()
        for i, n in enumerate(same):
            if n == _HEAD or n > min(len(some[i]), len(some[i + 1])):  # longer words, and those that end in zero characters
                same[i] = len(os.path.commonprefix((some[i], some[i + 1])))
        out += same if k else [0, *same]
    return out[: len(order)]


_OPEN: dict[bytes, Encoder] = {}


def encoder_for(model: bytes) -> Encoder:
    """The worker's encoder of a model, made once."""
    key = hashlib.md5(model).digest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Encoder(model)
    return _OPEN[key]


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about TEXTS bytes of the last column's text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(sizes // TEXTS)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _run(docs: DataFrame, model_path: str, keep: list[str], digest: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model_path, "rb") as f:  # the tokenizer's file lies beside the driver's installation; its bytes go along
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(held.value)
        for whole in batches:
            for b in by_bytes(whole):
                texts = b.column(b.num_columns - 1).to_pylist()
                ids = enc.encode(texts)
                cols, names = list(b.columns[:-1]), list(b.schema.names[:-1])
                cols.append(pa.array([None if x is None else len(x) for x in ids], pa.int64()))
                names.append("n_ids")
                if digest:
                    back = [None if x is None else enc.decode(x.tolist()) for x in ids]
                    cols += [
                        pa.array([None if x is None else hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([None if x is None else hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
                        pa.array([None if x is None else x == t for x, t in zip(back, texts, strict=True)], pa.bool_()),
                    ]
                    names += ["ids_md5", "decoded_md5", "same"]
                else:
                    ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate([x for x in ids if x is not None]) if any(x is not None for x in ids) else np.zeros(0, np.int32)
                    gone = pa.array([x is None for x in ids])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=gone))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("gl_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(returning(run), f"{kinds}, n_ids long, " + ("ids_md5 string, decoded_md5 string, same boolean" if digest else "ids array<int>"))


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole ``text``: the columns in ``keep``, n_ids and ids.

    The ids are those that the public library's encoder gives for the model.
    Defined cases: a null text has null ids, an empty one none; repeated rows
    each give a row; an empty table gives an empty table; further columns are
    not looked at. Models with a normalisation of their own are refused.
    """
    return _run(docs, model_path, list(keep), digest=False)


def decode(rows: DataFrame, model_path: str, column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of a table of token ids: the columns in ``keep``, and ``text``.

    The inverse of :func:`encode` where a text can be given back whole (a text
    of whole UTF-8, a mark in it as a space). Defined cases: null ids have a
    null text, no ids the empty one; a null, negative or unknown id is an
    error; repeated rows each give a row; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(held.value)
        for b in batches:
            ids = b.column(b.num_columns - 1)
            least, most = pc.min_max(ids.flatten()).values()
            if ids.flatten().null_count or (least.is_valid and not 0 <= least.as_py() <= most.as_py() < len(enc.raw)):
                raise ValueError("an id that the model doesn't have")
            texts = [None if x is None else enc.decode(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    taken = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("array<int>").alias("gl_ids"))
    return taken.mapInArrow(returning(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1]), "text string"]))


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_md5 (of the ids as 32-bit little-endian numbers), decoded_md5 and same (whether decoding gives the text back).

    Defined cases: as :func:`encode`; a null text has null digests, and a null ``same``.
    """
    return _run(docs, model_path, ["doc_id"], digest=True)
