"""Byte-level BPE by a distinct-word table.

Texts are split into words in Spark tasks.  A batch of documents (a block)
keeps its documents as positions into its list of distinct words.  The words
of all blocks are dealt by word, so each distinct word is encoded in one
place; the ids return to the blocks and are joined back by position.
Decoding joins ids with the vocabulary's pieces, a table of fixed size.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstile.llm import textarrays as ta

# A task has one core; the library's own threads would only take those of other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The characters with the Unicode property White_Space, and the word pattern of byte-level BPE.
_WS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS_PER_CALL = 256
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_UNIT = regex.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_WS_BEFORE_BLANK = regex.compile(rf"[{_WS}] ")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=4)
def _added(path: str):
    """Pattern that cuts out the added tokens, and their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens) or spec["normalizer"]:
        raise ValueError("only plain added tokens and no normalizer are supported")
    if not tokens:
        return None, {}
    by_length = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")"), {t["content"]: t["id"] for t in tokens}


_ASCII_WS_BEFORE_BLANK = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


def units(text: str) -> list[str]:
    """Cuts a text before runs of white space.

    No word crosses such a cut and none depends on what stands before it, so
    the words of the text are the words of its units.
    """
    if not text:
        return []
    if text.isascii():
        plain = not any(x in text for x in _ASCII_WS_BEFORE_BLANK)
    else:
        plain = _WS_BEFORE_BLANK.search(text) is None
    if plain:
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        return [first, *out] if first else out
    return _UNIT.findall(text)


def _small_unique(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with its inverse for numbers below ``bound``, without sorting them."""
    there = np.zeros(bound, bool)
    there[key] = True
    distinct = np.flatnonzero(there)
    place = np.zeros(bound, np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[key]


class _Numbers(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Block:
    """Distinct words of some documents, and the documents as word positions."""

    def __init__(self, path: str):
        self.added, self.added_ids = _added(path)
        self.words, self.units = _Numbers(), _Numbers()
        self.unit_words: list[np.ndarray] = []      # words of the units end to end, in units' order
        self.unit_sizes: list[np.ndarray] = []
        self.stream: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def _split_units(self, fresh: list[str]) -> None:
        """Words of new units: those that stand between white space are split as one text."""
        plain = [u[0] == " " and u not in self.added_ids and not u[-1].isspace() for u in fresh]
        joined = [u for u, p in zip(fresh, plain) if p]
        words = _WORD.findall("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        edges = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        size = np.diff(np.searchsorted(ends, edges, "right"), prepend=0)
        number = self.words
        flat = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        if len(joined) < len(fresh):
            others = [[u] if u in self.added_ids else _WORD.findall(u) for u, p in zip(fresh, plain) if not p]
            other_flat = np.array([number[w] for x in others for w in x], np.int32)
            other_size = np.array([len(x) for x in others], np.int64)
            mask = np.array(plain)
            sizes = np.empty(len(fresh), np.int64)
            sizes[mask], sizes[~mask] = size, other_size
            whose = np.repeat(mask, sizes)
            merged = np.empty(len(whose), np.int32)
            merged[whose], merged[~whose] = flat, other_flat
            flat, size = merged, sizes
        self.unit_words.append(flat)
        self.unit_sizes.append(size)

    def add(self, texts: pa.Array) -> None:
        """Numbers the units of some texts (null: empty).

        Texts whose units are cut by blanks alone are split and numbered as
        Arrow columns; only distinct units become Python strings.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        known, done = self.units, len(self.units)
        odd = pc.match_substring_regex(texts, _WS_BEFORE_BLANK.pattern)
        for token in self.added_ids:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        flat, sizes = self._cut_by_blanks(texts.filter(pa.array(~odd)))
        if odd.any():
            parts = [[known[u] for u in self._cut(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
            all_sizes = np.empty(len(texts), np.int64)
            all_sizes[~odd], all_sizes[odd] = sizes, [len(x) for x in parts]
            whose = np.repeat(odd, all_sizes)
            merged = np.empty(len(whose), np.int32)
            merged[~whose], merged[whose] = flat, np.array([u for x in parts for u in x], np.int32)
            flat, sizes = merged, all_sizes
        self.stream.append(flat)
        self.lengths.append(sizes)
        self._split_units(list(itertools.islice(reversed(known), len(known) - done))[::-1])

    def _cut(self, text: str) -> list[str]:
        if self.added is None:
            return units(text)
        return [u for x in self.added.split(text) for u in ([x] if x in self.added_ids else units(x))]

    def _cut_by_blanks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of texts in which no white space stands before a blank, and units per text."""
        pieces = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes                     # every text has a piece; its first one has no blank before it
        leads = np.zeros(len(code), bool)
        leads[first] = True
        key = code * 2 + leads
        distinct, place = _small_unique(key, 2 * len(coded.dictionary))
        strings, lead = coded.dictionary.take(pa.array(distinct // 2)), (distinct & 1).astype(bool)
        known, number = self.units, np.empty(len(distinct), np.int32)
        inner = pc.binary_join_element_wise(pa.scalar(" ", strings.type), strings.filter(pa.array(~lead)), pa.scalar("", strings.type))
        number[~lead] = np.fromiter(map(known.__getitem__, inner.to_numpy(zero_copy_only=False)), np.int32, len(inner))
        number[lead] = [known[s] if s else -1 for s in strings.filter(pa.array(lead)).to_pylist()]
        flat = number[place]
        sizes[flat[first] < 0] -= 1                          # a text that begins with a blank, or is empty
        return flat[flat >= 0], sizes

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of all documents end to end, and words per document."""
        flat = np.concatenate(self.stream) if self.stream else np.zeros(0, np.int32)
        n_units = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        sizes = np.concatenate(self.unit_sizes) if self.unit_sizes else np.zeros(0, np.int64)
        words = np.concatenate(self.unit_words) if self.unit_words else np.zeros(0, np.int32)
        flat, size = spread(words, (np.cumsum(sizes) - sizes)[flat], sizes[flat])
        total = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(n_units)])
        return flat, total[edge[1:]] - total[edge[:-1]]


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts : starts + sizes]`` end to end, and their sizes."""
    n = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - begin, sizes) + np.arange(n)], sizes


def _blocks(batches, path):
    """One block for each incoming batch, named by its place and its ids."""
    task = TaskContext.get().partitionId()
    for k, b in enumerate(batches):
        ids = b.column(0).cast(pa.int64())
        block = Block(path)
        _, offs = ta.text_buffer(b.column(1))
        for i, j in ta.chunks(offs, 4 << 20):
            block.add(b.column(1).slice(i, j - i))
        seen = ids.fill_null(-1).to_numpy(zero_copy_only=False).tobytes()
        yield xxhash.xxh64_intdigest(seen, seed=(task << 20) + k) - (1 << 63), ids, block


def _words_of(path):
    def run(batches):
        for name, _, block in _blocks(batches, path):
            words = list(block.words)
            for a in range(0, len(words), 1 << 16):
                some = words[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.string()), pa.array(np.full(len(some), name)),
                     pa.array(np.arange(a, a + len(some), dtype=np.int32))], names=["word", "block", "at"])
    return ta.tidy(run)


def _planes(x: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unplanes(x: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _documents_of(path):
    def run(batches):
        for name, ids, block in _blocks(batches, path):
            flat, sizes = block.positions()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([_planes(sizes)]), pa.array([_planes(flat)])],
                names=["block", "doc_ids", "sizes", "positions"])
    return ta.tidy(run)


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of single words end to end, and ids per word; each is encoded on its own.

    Words that begin with their only blank are joined to texts, which the
    tokenizer cuts before every blank and so back into these words.
    """
    added_ids = _added(path)[1]
    can_join = not any(c.isspace() for token in added_ids for c in token)
    joined = np.fromiter((can_join and len(w) > 1 and w[0] == " " and not w[1].isspace() and w not in added_ids for w in words), bool, len(words))
    parts = [_encode_groups(list(itertools.compress(words, pick)), path, whole) for pick, whole in ((joined, True), (~joined, False))]
    sizes = np.empty(len(words), np.int64)
    sizes[joined], sizes[~joined] = parts[0][1], parts[1][1]
    whose = np.repeat(joined, sizes)
    ids = np.empty(len(whose), np.int64)
    ids[whose], ids[~whose] = parts[0][0], parts[1][0]
    return ids, sizes


def _encode_groups(words: list[str], path: str, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ids per word of WORDS_PER_CALL words at a time, handed over as one text or word by word."""
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    groups = [words[i:i + WORDS_PER_CALL] for i in range(0, len(words), WORDS_PER_CALL)]
    calls = ["".join(g) for g in groups] if joined else groups
    for group, x in zip(groups, _tokenizer(path).encode_batch(calls, is_pretokenized=not joined, add_special_tokens=False)):
        n = np.bincount(np.array(x.word_ids, np.int64), minlength=len(group))
        if joined and (len(n) > len(group) or not n.all()):  # the tokenizer cuts elsewhere
            some, n = _encode_groups(group, path, False)
        else:
            some = np.array(x.ids, np.int64)
        ids.append(some)
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


def _id_type(path: str) -> np.dtype:
    """The narrowest type that holds every id, for ids on their way through a shuffle."""
    return np.dtype("<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def _encode_sorted(path):
    """Rows sorted by word: each distinct word is encoded once."""
    def run(batches):
        kind = _id_type(path)
        last, last_ids = None, b""
        for b in batches:
            coded = b.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [w for w in distinct if w != last]
            ids, sizes = encode_words(new, path)
            width = kind.itemsize
            raw, ends = ids.astype(kind).tobytes(), np.cumsum(sizes) * width
            table = {w: raw[e - width * n:e] for w, e, n in zip(new, ends.tolist(), sizes.tolist())}
            if last is not None:
                table[last] = last_ids
            packed = pa.array([table[w] for w in distinct], pa.binary())
            if distinct:
                last = b.column(0)[-1].as_py()
                last_ids = table[last]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), packed.take(coded.indices)], names=["block", "at", "ids"])
    return ta.tidy(run)


def _join_back(path, decoded):
    """Ids of a block's documents from the ids of its words; with their texts if asked for."""
    def run(coded: pa.Table, docs: pa.Table) -> pa.Table:
        return _documents(coded, docs, path, decoded)
    return ta.tidy_group(run)


def _documents(coded: pa.Table, docs: pa.Table, path: str, decoded: bool) -> pa.Table:
    kind = _id_type(path)
    out = []
    if docs.num_rows != 1:
        raise RuntimeError("a block was cut differently on a second read; write the documents to a table first")
    at = coded.column("at").to_numpy()
    raw = coded.column("ids").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    _, offsets, data = raw.cast(pa.large_binary()).buffers() if len(raw) else (None, None, None)
    offs = np.frombuffer(offsets, np.int64)[:len(raw) + 1] // kind.itemsize if len(raw) else np.zeros(1, np.int64)
    values = np.frombuffer(data, kind) if len(raw) and data is not None else np.zeros(0, kind)
    start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    start[at], size[at] = offs[:-1], np.diff(offs)
    ids = docs.column("doc_ids").combine_chunks().flatten()
    sizes = _unplanes(docs.column("sizes")[0].as_py()).astype(np.int64)
    flat = _unplanes(docs.column("positions")[0].as_py())
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in ta.chunks(edge, 1 << 20):
        pos = flat[edge[i]:edge[j]]
        tokens, n = spread(values, start[pos], size[pos])
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[edge[i:j + 1] - edge[i]]
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends * 4), pa.py_buffer(tokens.astype("<u4"))])
        rows = {"doc_id": ids.slice(i, j - i), "n_tokens": pa.array(np.diff(ends)), "ids": body.cast(pa.binary())}
        if decoded:
            rows["decoded"] = pa.array(_texts(tokens, ends, path), pa.string())
        out.append(pa.table(rows))
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.concat_tables(out) if out else pa.table([pa.array([], k) for _, k in zip(names, kinds)], names=names)


def encode(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every row.

    With ``decoded``, the text decoded from the ids is added as :func:`decode` does.

    ``path`` names the tokenizer's JSON file, present on every machine.  A
    null text counts as empty and has no ids; repeated rows and ids (null
    too) stay; other columns are ignored; an empty table gives none.  An
    added token's string in a text becomes its id, as the library does.  The
    rows are read twice and must come in the same batches (a scan does; else
    write them first): if not, the join back raises an error.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = texts.mapInArrow(_words_of(path), "word string, block long, at int")
    coded = (words.repartition("word").sortWithinPartitions("word")
             .mapInArrow(_encode_sorted(path), "block long, at int, ids binary"))
    blobs = texts.mapInArrow(_documents_of(path), "block long, doc_ids array<long>, sizes binary, positions binary")
    return (coded.groupBy("block").cogroup(blobs.groupBy("block"))
            .applyInArrow(_join_back(path, decoded), "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded))


@functools.lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, and each id's start and length."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    byte_of = byte_alphabet()
    by_id = {i: bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
             for piece, i in vocab.items()}
    joined = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    size = np.array([len(x) for x in joined], np.int64)
    return np.frombuffer(b"".join(joined), np.uint8), np.cumsum(size) - size, size


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _texts(ids: np.ndarray, ends: np.ndarray, path: str) -> list[str]:
    """Texts of documents whose ids stand end to end: ids joined with their pieces."""
    data, start, size = _pieces(path)
    body, n = spread(data, start[ids], size[ids])
    at = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
    whole = body.tobytes()
    return [whole[p:q].decode("utf-8", "replace") for p, q in zip(at[:-1], at[1:])]


def _decode(path):
    def run(batches):
        for b in batches:
            raw, offs = _binary(b.column(2))
            edge = offs // 4
            for i, j in ta.chunks(edge, 1 << 20):
                ids = np.frombuffer(raw[offs[i]:offs[j]].tobytes(), "<u4").astype(np.int64)
                texts = _texts(ids, edge[i:j + 1] - edge[i], path)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in b.columns] + [pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])
    return run


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to the rows of :func:`encode`; invalid bytes become U+FFFD."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decode(path), "doc_id long, n_tokens long, ids binary, decoded string")
