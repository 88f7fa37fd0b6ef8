"""Token ids in a grammar-compressed binary format.

Documents are range-partitioned by doc_id, tokenised, ended with id 0 and
packed into blocks of about ``BLOCK_TOKENS`` ids. A block is compressed by
Re-Pair in rounds: the most frequent adjacent id pairs are replaced by
nonterminals, left to right without overlap and never across the end of a
document, until no pair is frequent or the nonterminals run out. The file
keeps the rules, each rule's expansion length and the place of every document,
so one document can be decoded without the others.

Block layout (little-endian): magic ``RPB1``; uint32 n_docs, n_rules, first
nonterminal, symbol width in bytes, and n_symbols; rules (2 uint32 each);
expansion lengths (uint32); doc ids (int64) and their null marks (uint8);
symbol offsets (uint64, n_docs + 1); token counts (uint64); symbols. Blocks are
the binary rows of a Parquet table with their partition and number, so any
store that Spark reads will do.

Defined results: null and empty texts hold the end id alone. Rows are ordered
by doc_id (null first), then by a hash of the text; repeated rows are kept.
Strings of special tokens become their ids, as the library does by default.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import shared_dir, table

END_ID = 0
BLOCK_TOKENS = 1 << 20
PAIRS_A_ROUND, MIN_COUNT = 4096, 8
MEMO, LONG_KEY = 400_000, 64
SLICE_CHARS = 1 << 23                                      # texts of about so many bytes are encoded at once
_WIDE_GAP = re.compile(r" (?:\s|\Z)").search                  # a space with no sign right after it
_WORD_GAP = re.compile(r" (?=\S)")
_PLAIN_WORD = r"\A(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<signs>[!-/:-@]*)\z"
_SEPARATOR, _TOGETHER = 255, 128                           # a byte that UTF-8 never has; pieces merged by one call
_HEAD = struct.Struct("<4sIIIIQ")


class Memo(dict):
    """``make(keys)`` remembered; when ``room`` is used up, only what was used lately stays.

    Keys over ``LONG_KEY`` letters are made anew each time, so the size is bounded.
    """

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room, self.before = make, room, {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make([key])[0]
        self.keep({key: got})
        return got

    def keep(self, more: dict[str, bytes]) -> None:
        more = {k: more[k] for k in more if len(k) <= LONG_KEY}
        if len(more) > self.room:
            more = dict(itertools.islice(more.items(), self.room))
        if len(self) + len(more) > self.room:
            self.before = dict(self)
            self.clear()
        self.update(more)

    def take(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys; the unknown ones are made together."""
        got = list(map(self.get, keys))
        miss = [k for k, v in zip(keys, got) if v is None]
        if not miss:
            return got
        more = dict(zip(miss, map(self.before.get, miss)))
        fresh = [k for k, v in more.items() if v is None]
        if fresh:
            more.update(zip(fresh, self.make(fresh)))
        self.keep(more)
        return [more[k] if v is None else v for k, v in zip(keys, got)]


class Encoder:
    """The tokenizer with a bounded memory of words and of the pieces in them.

    Byte-level BPE never merges across the pieces that its pattern cuts, so a
    piece's ids can be kept; the library's merges run on the pieces that are new,
    many at a call, parted by a byte that no merge of the vocabulary has.
    The pattern always cuts before a space with a letter or sign after it and
    around the line breaks between two signs, so texts are first split there:
    a word is what follows a space, or a run of line breaks with what follows it.
    Texts with other white space at a word's edge are cut by the pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.vocab = self.tok.get_vocab_size()
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        # byte-level BPE writes each byte as a letter: itself if printable, else the next one from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.letters = "".join(chr(b if b in plain else 256 + rest.index(b)) for b in range(256))
        self.merges = Tokenizer(self.tok.model)             # the model alone: takes byte letters, cuts nothing
        part, vocab = self.letters[_SEPARATOR], self.tok.get_vocab(with_added_tokens=False)
        self.separator = vocab.get(part)
        self.together = _TOGETHER if [t for t in vocab if part in t] == [part] else 1
        self.piece = Memo(self._merge, MEMO // 4)
        self.head = Memo(lambda keys: self._join(map(self.pieces, keys)), MEMO // 4)   # a word that no space precedes
        self.word = Memo(self._cut_words, MEMO)             # a word after a space, or line breaks and a word

    def _merge(self, pieces: list[str]) -> list[bytes]:
        raw = list(map(str.encode, pieces))
        flat, place, size = self._merge_joined(
            [bytes([_SEPARATOR]).join(raw[i:i + self.together]) for i in range(0, len(raw), self.together)])
        ids = flat.tobytes()
        return [ids[a:z] for a, z in zip((4 * place).tolist(), (4 * (place + size)).tolist())]

    def _merge_joined(self, joined: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many they are, of pieces joined by the separator."""
        letters = [codecs.charmap_decode(j, "strict", self.letters)[0] for j in joined]
        ids = [e.ids for e in self.merges.encode_batch_fast(letters, add_special_tokens=False)]
        if self.together == 1:
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(itertools.chain.from_iterable(ids), "<u4"), np.cumsum(size) - size, size
        flat = np.fromiter(itertools.chain.from_iterable([*i, self.separator] for i in ids), "<u4")
        end = np.flatnonzero(flat == self.separator)
        place = np.append(0, end + 1)[:-1]
        return flat, place, end - place

    def _merge_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of plain letters, each with a space before it."""
        cuts = np.append(np.arange(0, len(words), self.together), len(words))
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar("\x01 ", words.type))
        sign = bytes([_SEPARATOR])
        return self._merge_joined([b" " + r.replace(b"\x01", sign) for r in rows.cast(pa.large_binary()).to_pylist()])

    def _cut_words(self, words: list[str]) -> list[bytes]:
        """Ids of words; none for a word that cannot be taken alone, with white space at its edge."""
        cut = []
        for w in words:
            core = w.lstrip("\n")
            if not core:
                cut.append((w or " ",))
            elif core[0].isspace() or core[-1].isspace():
                cut.append(())
            else:
                cut.append(self.pieces(w if w[0] == "\n" else " " + w))
        return self._join(cut)

    def _join(self, cut) -> list[bytes]:
        cut = list(cut)
        need = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        ids = dict(zip(need, self.piece.take(need)))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def _spaced(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with any white space, ended with the end id."""
        split = [_WORD_GAP.split(t) if _WIDE_GAP(t) else t.split(" ") for t in texts]
        words = list(dict.fromkeys(w for _, *more in split for w in more))
        whole, edged = [w for w in words if not w[-1].isspace()], [w for w in words if w[-1].isspace()]
        ids = dict(zip(whole, self.word.take(whole)))
        ids.update(zip(edged, self._join(self.pieces(" " + w) for w in edged)))
        heads = list(dict.fromkeys(first for first, *_ in split))
        head = dict(zip(heads, self.head.take(heads)))
        return [np.frombuffer(b"".join([head[first], *map(ids.__getitem__, more), _END]), "<u4") for first, *more in split]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, ended with the end id."""
        out, plain = [None] * len(texts), []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array([*self.tok.encode(t, add_special_tokens=False).ids, END_ID], "<u4")
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._many([texts[i] for i in plain])):
                out[i] = ids
        spaced = [i for i in plain if out[i] is None]
        for i, ids in zip(spaced, self._spaced([texts[i] for i in spaced])):
            out[i] = ids
        return out

    def _many(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts by their distinct words, ended with the end id; none for a text to be cut by the pattern."""
        lines = pc.replace_substring_regex(pa.array(texts, pa.large_string()), r"(\n+)", r" \1")
        split = pc.split_pattern(lines, " ")
        at = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        code, keys = words.indices.to_numpy().copy(), words.dictionary
        opens = pc.or_(pc.starts_with(keys, "\n"), pc.equal(keys, "")).to_numpy(zero_copy_only=False)
        # plain letters and the signs after them are two pieces; other words are remembered
        parts = pc.extract_regex(keys, _PLAIN_WORD)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        stems, signs = (parts.filter(parts.is_valid()).field(f).dictionary_encode() for f in ("letters", "signs"))
        other = keys.filter(pa.array(~plain)).to_pylist()
        other_ids = self.word.take(other)
        # a word with white space at its edge cannot be taken alone, nor two words that are one run of white space
        odd, shuts = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        odd[~plain], shuts[~plain] = [not i for i in other_ids], [not k.strip("\n") for k in other]
        odd = odd[code]
        odd[:-1] |= shuts[code[:-1]] & opens[code[1:]]
        heads = keys.take(pa.array(code[at[:-1]])).to_pylist()
        odd[at[:-1]] = [h[-1:].isspace() for h in heads]
        good = ~np.logical_or.reduceat(odd, at[:-1])
        if not good.any():
            return [None] * len(texts)
        heads = list(itertools.compress(heads, good))
        head = list(dict.fromkeys(heads))
        head = dict(zip(head, self.head.take(head)))
        sign = [self.piece[g] if g else b"" for g in signs.dictionary.to_pylist()]
        pool, place, size = self._merge_plain(stems.dictionary)
        more = [*sign, b"", *other_ids, *(_END + head[h] for h in heads), _END]
        more_size = np.fromiter(map(len, more), np.int64, len(more)) // 4
        place = np.concatenate([place, len(pool) + np.cumsum(more_size) - more_size])
        size, pool = np.concatenate([size, more_size]), np.concatenate([pool, np.frombuffer(b"".join(more), "<u4")])
        # each key in two segments of the pool, then each text in keys; the end id stands before a text's head
        n_keys, n_words, n_stems = len(keys), np.diff(at), len(stems.dictionary)
        none = n_stems + len(sign)
        segment = np.full((n_keys + len(heads) + 1, 2), none)
        segment[:n_keys][plain, 0], segment[:n_keys][plain, 1] = stems.indices, n_stems + signs.indices.to_numpy()
        segment[:n_keys][~plain, 0] = none + 1 + np.arange(len(other))
        segment[n_keys:, 0] = none + 1 + len(other) + np.arange(len(heads) + 1)
        pool, size = _gather(pool, place, size, segment.ravel()), size[segment].sum(axis=1)
        code = code[np.repeat(good, n_words)]
        first = np.cumsum(n_words[good]) - n_words[good]
        code[first] = n_keys + np.arange(len(first))
        flat = _gather(pool, np.cumsum(size) - size, size, np.append(code, len(segment) - 1))
        begin = np.cumsum(size[code]) - size[code]
        cuts = iter(np.split(flat[1:], begin[first][1:]))
        return [next(cuts) if g else None for g in good]


def _gather(pool: np.ndarray, place: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``pool[place:place + size]`` of each of ``which``, one after the other."""
    n = size[which]
    spot = np.repeat(place[which] - (np.cumsum(n) - n), n)
    spot += np.arange(len(spot))
    return pool[spot]


_END = np.array([END_ID], "<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def repair(ids: np.ndarray, ends: np.ndarray, vocab: int, top: int = PAIRS_A_ROUND,
           least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of documents, rules). ``ends``: offsets of the documents in ``ids``."""
    narrow = vocab < 60_000
    room = (1 << 16) - vocab if narrow else (1 << 31) - vocab
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    seq, rules, known = ids.astype(kind), [], 0
    closes = np.zeros(len(seq), bool)
    closes[ends[1:] - 1] = True
    pairs, often = _frequent(((seq[:-1] << kind(shift)) | seq[1:])[~closes[:-1]], least)
    while len(pairs) and known < room:
        best = np.lexsort((pairs, -often))[:min(top, room - known)]
        # an open table finds the pairs; of pairs on one place the most frequent is taken now
        _, one = np.unique(_slot(pairs[best]), return_index=True)
        best = best[np.sort(one)]
        pick, slot = pairs[best], _slot(pairs[best])
        key = (seq[:-1] << kind(shift)) | seq[1:]
        used = np.zeros(_SLOTS, bool)
        used[slot] = True
        place = np.zeros(_SLOTS, np.int32)
        place[slot] = np.arange(len(pick), dtype=np.int32)
        spot = _slot(key)
        at = np.flatnonzero(used[spot])
        where = place[spot[at]]
        hit = (pick[where] == key[at]) & ~closes[at]
        at, where = at[hit], where[hit]
        # runs of neighbouring hits overlap: every second one of a run is replaced
        begins = np.ones(len(at), bool)
        begins[1:] = np.diff(at) != 1
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        at, where = at[even], where[even]
        # every place of a picked pair is gone now; other old pairs only lose the places beside a new symbol
        rest = np.ones(len(pairs), bool)
        rest[best] = False
        pairs, often = pairs[rest], often[rest]
        if len(pairs):
            lost = np.concatenate([at[np.diff(at, prepend=-3) != 2] - 1, at + 1])
            lost = lost[(lost >= 0) & (lost < len(key))]
            lost = key[lost[~closes[lost]]]
            up = np.argsort(pairs)
            pairs, often = pairs[up], often[up]
            slot = np.minimum(np.searchsorted(pairs, lost), len(pairs) - 1)
            often = often - np.bincount(slot[pairs[slot] == lost], minlength=len(pairs))
            pairs, often = pairs[often >= least], often[often >= least]
        seq[at] = vocab + known + where
        closes[at] |= closes[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, closes = seq[keep], closes[keep]
        # new pairs have a new symbol: they stand beside the places replaced
        at -= np.arange(len(at))
        near = np.concatenate([at[np.diff(at, prepend=-2) != 1] - 1, at])
        near = near[(near >= 0) & (near < len(seq) - 1)]
        near = near[~closes[near]]
        new, n = _frequent((seq[near] << kind(shift)) | seq[near + 1], least)
        pairs, often = np.concatenate([pairs, new]), np.concatenate([often, n])
        rules.append(np.stack([pick >> kind(shift), pick & kind((1 << shift) - 1)], axis=1).astype(np.uint32))
        known += len(pick)
    off = np.concatenate([[0], np.flatnonzero(closes) + 1])
    return seq, off, np.concatenate([np.zeros((0, 2), np.uint32), *rules])


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that stand at ``least`` places or more, ascending, and their counts."""
    ranked = np.sort(keys)
    if len(ranked) < least:
        return ranked[:0], np.zeros(0, np.int64)
    # a key with ``least`` places has the same key so far behind its first one
    far = ranked[least - 1:] == ranked[:len(ranked) - least + 1]
    first = np.flatnonzero(far & np.append(True, ranked[1:len(far)] != ranked[:len(far) - 1]))
    return ranked[first], np.searchsorted(ranked, ranked[first], "right") - first


_SLOTS = 1 << 18


def _slot(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def _levels(rules: np.ndarray, vocab: int):
    """Bounds of consecutive rules that only use symbols known before the first of them."""
    uses, lo = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64)), 0
    while lo < len(rules):
        hi = int(np.searchsorted(uses, vocab + lo))
        yield lo, hi
        lo = hi


def expansion_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    n = np.ones(vocab + len(rules), np.int64)
    for lo, hi in _levels(rules, vocab):
        n[vocab + lo:vocab + hi] = n[rules[lo:hi]].sum(axis=1)
    return n


def pack(ids: list[int | None], tokens: list[np.ndarray], vocab: int) -> bytes:
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    seq, off, rules = repair(flat, ends, vocab)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    return b"".join([
        _HEAD.pack(b"RPB1", len(ids), len(rules), vocab, width, len(seq)), rules.astype("<u4").tobytes(),
        expansion_lengths(rules, vocab)[vocab:].astype("<u4").tobytes(),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(),
        off.astype("<u8").tobytes(), np.diff(ends).astype("<u8").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Block:
    """A packed block; ``doc(i)`` decodes one document, ``tokens()`` all of them."""

    def __init__(self, raw: bytes):
        magic, n, n_rules, self.vocab, width, n_symbols = _HEAD.unpack_from(raw)
        if magic != b"RPB1":
            raise ValueError("not a token block")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.length = np.concatenate([np.ones(self.vocab, np.int64), take("<u4", n_rules).astype(np.int64)])
        ids, null = take("<i8", n), take("u1", n)
        self.ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.offsets = take("<u8", n + 1).astype(np.int64)
        self.counts = take("<u8", n).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols).astype(np.int64)
        self.flat = np.zeros(int(self.length.sum()), np.uint32)
        self.place = np.cumsum(self.length) - self.length
        self.flat[:self.vocab] = np.arange(self.vocab)
        for lo, hi in _levels(self.rules, self.vocab):
            ids = self._expand(self.rules[lo:hi].ravel())
            begin = self.place[self.vocab + lo]
            self.flat[begin:begin + len(ids)] = ids

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.place[symbols] - begin, n) + np.arange(int(n.sum()))]

    def doc(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.offsets[i]:self.offsets[i + 1]])

    def tokens(self) -> np.ndarray:
        return self._expand(self.symbols)


def _pack_rows(path: str):
    names = ["part", "block", "n_docs", "n_tokens", "payload"]

    def run(batches):
        part = TaskContext.get().partitionId()
        enc, ids, toks, held, block = encoder(path), [], [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([pack(ids, toks, enc.vocab)], pa.binary())], names)

        for b in batches:
            n = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(n) - n) // SLICE_CHARS)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                texts = [t or "" for t in b.column("text")[lo:hi].to_pylist()]
                for i, t in zip(b.column("doc_id")[lo:hi].to_pylist(), enc(texts)):
                    ids.append(i), toks.append(t)
                    held += len(t)
                    if held >= BLOCK_TOKENS:
                        yield row()
                        ids, toks, held, block = [], [], 0, block + 1
        if ids:
            yield row()
        pa.default_memory_pool().release_unused()           # the worker stays; other steps' tasks need the room
    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the blocks of all documents, in ascending doc_id order, to ``path``."""
    part = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
            .repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    part.mapInArrow(_pack_rows(tokenizer), "part int, block int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def _read_rows(batches):
    for b in batches:
        for part, block, raw in zip(b.column("part"), b.column("block"), b.column("payload")):
            k = Block(raw.as_py())
            tokens = k.tokens().astype("<u4")
            end = np.cumsum(k.counts)
            n = len(k.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(k.ids, pa.int64()),
                 pa.array(end - k.counts), pa.array(k.counts),
                 pa.array([zlib.crc32(tokens[e - c:e].tobytes()) for e, c in zip(end, k.counts)], pa.int64())],
                ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``."""
    files = spark.read.parquet(path)
    size = files.select("part", "block", "n_tokens")
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n"))           # a row for each write task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    begin = (size.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, "part")
             .select("part", "block", (F.col("before") + F.col("own")).alias("begin")))
    docs = files.select("part", "block", "payload").mapInArrow(
        _read_rows, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(begin, ["part", "block"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    import uuid

    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path)
    return read_tokens(spark, path)


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what the token files hold, one row per document."""
    return token_output(spark, docs)
