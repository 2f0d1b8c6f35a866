"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes tokens for every new word, one vectorised check over
all adjacent pairs of the batch tells which proposals the merge order would have made,
and only failing words go through exact merging.

Why checking pairs is enough: a token sequence is the merge result exactly if each
token is what merging yields for its own bytes and no merge of lower rank could ever
have joined the two sides of any boundary.  For one boundary the candidates are found
by undoing the merges of the tokens beside it, latest first.

Two vocabulary families are read from ``tokenizers`` JSON files: byte-level BPE that
keeps white space, and lower-case BPE with word ends that drops it.

Cases: null texts encode as empty; special strings in a text map to their ids as in
the library; texts with characters outside the first 592 code points are normalised and
split by the library's own rules before the same encoder sees their words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewater.llm.common import clean_text

#: Remembered chunks of a worker, in each of two generations: when the young one is
#: full it becomes the old one, from which chunks in use move back.
CACHE_BOUND = 300_000
#: Characters of text that are tokenised at a time.
STEP = 1 << 21
_PLAIN = 0x250  # below it, composition never changes a text and classes are tabled


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE files use for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def _class(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c)).startswith(prefix))


_L, _N = _class("L"), _class("N")
_WHITE = "\\t-\\r \\x85\\xa0"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(f"{_ENDS}|[{_L}]+|[{_N}]|[^{_WHITE}{_L}{_N}]+")
BYTE_PIECES = re.compile(f"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^{_WHITE}{_L}{_N}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
BYTE_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Characters that Python and the library class differently, or that are not tabled.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")


class Bpe:
    """One vocabulary: ids of words, pieces and texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.word_ends = model.get("end_of_word_suffix") or ""
        self.keeps_space = not self.word_ends
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {self._fold(k): v for k, v in model["vocab"].items()}
        merges = [tuple(map(self._fold, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        base = sorted((k for k in vocab if len(k) == 1), key=vocab.get)
        # own numbers follow the order of creation: bytes first, then merges by rank
        names = [*base, *(a + b for a, b in merges)]
        order = {k: i for i, k in enumerate(names)}
        if len(order) != len(names):
            raise ValueError("two merges make the same token")
        n, nb = len(names), len(base)
        self.to_id = np.array([vocab[k] for k in names], np.uint32)
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[nb:] = [order[a] for a, _ in merges]
        self.right[nb:] = [order[b] for _, b in merges]
        self.n, self.base, self.pairs = n, {k: order[k] for k in base}, {}
        keys = self.left[nb:] * n + self.right[nb:]
        self.pairs = {int(k): nb + i for i, k in enumerate(keys)}
        rank = np.argsort(keys, kind="stable")
        self.keys, self.made = np.append(keys[rank], np.iinfo(np.int64).max), np.append(rank + nb, n)
        tokens = np.arange(nb, n)
        good = np.ones(n, bool)
        good[nb:] = self.compatible(self.left[nb:], self.right[nb:], tokens)
        for t in tokens:  # a token is proposed only if merging its own bytes gives it
            good[t] &= good[self.left[t]] and good[self.right[t]]
        self.greedy = {k: i for i, k in enumerate(names) if good[i]}
        self.longest = max(map(len, self.greedy))
        texts = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.token_bytes = [b""] * (max(texts) + 1)
        for v, k in texts.items():
            self.token_bytes[v] = k.encode() if self.word_ends or v in self.special.values() else b"".join(back[c] for c in k)
        self.alphabet = {i: ord(c) for i, c in enumerate(byte_alphabet())}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old: dict[int, dict[str, bytes]] = {}

    def _fold(self, token: str) -> str:
        """A word end becomes part of the last character, as one symbol."""
        end = self.word_ends
        return token[: -len(end) - 1] + chr(ord(token[-len(end) - 1]) + 0x1000) if end and token.endswith(end) and token != end else token

    # -- the check of pairs ------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each i, whether merging the bytes of tokens a[i], b[i] leaves exactly these two.

        ``limit``: only merges before this one count (all by default)."""
        out = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), np.asarray(a, np.int64), np.asarray(b, np.int64)
        limit = np.full(len(a), self.n, np.int64) if limit is None else np.asarray(limit, np.int64)
        while len(at):
            key = a * self.n + b
            i = np.searchsorted(self.keys, key)
            joins = (self.keys[i] == key) & (self.made[i] < limit)
            out[at[joins]] = False
            # undo the later of the two merges; what stays beside the boundary could be
            # joined only by merges that come before the one just undone
            later = a > b
            nexta, nextb = self.right[a], self.left[b]
            bytea, byteb = nexta == a, nextb == b
            goa = np.where(later, ~bytea, byteb & ~bytea)
            gob = np.where(later, bytea & ~byteb, ~byteb)
            limit = np.where(goa, a, np.where(gob, b + 1, limit))
            a, b = np.where(goa, nexta, a), np.where(gob, nextb, b)
            more = (goa | gob) & ~joins
            at, a, b, limit = at[more], a[more], b[more], limit[more]
        return out

    # -- words -------------------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        get, out, i, n = self.greedy.get, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = get(word[i:j])
                if t is not None:
                    break
            out.append(t)
            i = j
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, of equals the leftmost."""
        pairs, n = self.pairs, self.n
        ids = [self.base[c] for c in word]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(t, i) for i in range(len(ids) - 1) if (t := pairs.get(ids[i] * n + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            t, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= len(ids) or pairs.get(ids[i] * n + ids[j]) != t:
                continue
            ids[i], ids[j], nxt[i] = t, -1, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
                if (u := pairs.get(t * n + ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (u, i))
            if prv[i] >= 0 and (u := pairs.get(ids[prv[i]] * n + t)) is not None:
                heapq.heappush(heap, (u, prv[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Own token numbers of each word of the file's alphabet."""
        if self.word_ends:
            words = [w[:-1] + chr(ord(w[-1]) + 0x1000) for w in words]
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for x in found for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        inner = owner[1:] == owner[:-1]
        wrong = ~self.compatible(flat[:-1][inner], flat[1:][inner])
        for k in np.unique(owner[1:][inner][wrong]):
            found[k] = self.merge(words[k])
        return found

    def _ids(self, pieces: list[list[str]]) -> list[bytes]:
        """Little-endian ids of each list of words of the file's alphabet."""
        found = self.encode_words([w for x in pieces for w in x])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = self.to_id[np.fromiter((t for x in found for t in x), np.int64, int(sizes.sum()))].astype("<u4").tobytes()
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))] * 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _map(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)

    # -- texts -------------------------------------------------------------------
    def _segments(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        if self.split_special is None or "<|" not in text:
            yield text, None
            return
        for k, x in enumerate(self.split_special.split(text)):
            if x:
                yield x, np.uint32(self.special[x]).astype("<u4").tobytes() if k % 2 else None

    def _chunks(self, text: str) -> tuple[dict[str, bytes], list[str]]:
        """The memory to look in, and the keys of the text in it."""
        if _ODD.search(text):
            lib = self.library
            if lib.normalizer is not None:
                text = lib.normalizer.normalize_str(text)
            return self.pieces, [x for x, _ in lib.pre_tokenizer.pre_tokenize_str(text)] if text else []
        return self.cache, BYTE_CHUNKS.findall(text) if self.keeps_space else text.lower().split()

    def _part(self, text: str) -> tuple:
        """(ids, None, None) where they are known at once, else (None, memory, keys)."""
        return None, *self._chunks(text)

    def _learn(self, memory: dict[str, bytes], missing: list[str]) -> None:
        if memory is self.pieces:
            lists = [[x] for x in missing]
        else:
            split = (BYTE_PIECES if self.keeps_space else WORD_PIECES).findall
            lists = [[self._map(p) for p in split(x)] for x in missing]
        memory.update(zip(missing, self._ids(lists), strict=True))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        waiting, chars = [], 0
        for text in texts:
            waiting.append([(special, None, None) if special else self._part(x) for x, special in self._segments(text)])
            chars += len(text)
            if chars >= STEP:
                yield from self._flush(waiting)
                waiting, chars = [], 0
        yield from self._flush(waiting)

    def _remember(self, memory: dict[str, bytes], keys: Iterable[str]) -> None:
        """Have all keys in a memory."""
        if len(memory) > CACHE_BOUND:
            self.old[id(memory)] = dict(memory)
            memory.clear()
        keys = [k for k in keys if k not in memory]
        if (old := self.old.get(id(memory))) and keys:
            memory.update((k, old[k]) for k in keys if k in old)
            keys = [k for k in keys if k not in memory]
        if keys:
            self._learn(memory, keys)

    def _flush(self, waiting: list) -> Iterator[bytes]:
        for memory in (self.cache, self.pieces):
            keys = set()
            for doc in waiting:
                for _, m, chunks in doc:
                    if m is memory:
                        keys.update(chunks)
            self._remember(memory, keys)
        for doc in waiting:
            yield b"".join(ids if m is None else b"".join(map(m.__getitem__, chunks)) for ids, m, chunks in doc)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False)."""
        tokens = map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b" ".join(tokens) if self.word_ends else b"".join(tokens).decode("utf-8", "replace").encode()


_END = "\x1f"  # in no plain text


class RankBpe(Bpe):
    """The same texts through a compiled encoder that merges by the rank of the result.

    Merging any two neighbours whose joint bytes are a token, lowest rank first, equals
    merging by the file's pairs if each token is what its own bytes merge to: were two
    tokens x, y neighbours that only the former would join, x + y alone would end as
    [x, y] under the file's merges, and so the joint token would not be reachable.
    That is checked for all tokens at loading; texts that are not plain, and
    vocabularies that fail the check, take the general way.
    """

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        self.fast = None
        if len(self.greedy) != self.n:
            return
        names = sorted(self.greedy, key=self.greedy.get)
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        if self.keeps_space:
            ranks = {b"".join(back[c] for c in k): i for i, k in enumerate(names)}
            self.fast, self.out = tiktoken.Encoding("bytes", pat_str=BYTE_PIECES.pattern, mergeable_ranks=ranks, special_tokens={}), self.to_id
            return
        # a word end is a byte that no plain text has, joined to its letter before all else
        end = _END.encode()
        spelt = [b"".join(back[c] for c in k[:-1]) + (back[chr(ord(k[-1]) - 0x1000)] + end if ord(k[-1]) >= 0x1000 else back[k[-1]]) for k in names]
        ends = [i for i, k in enumerate(names) if len(k) == 1 and ord(k) >= 0x1000]
        order = [*ends, *(i for i in range(len(names)) if not (len(names[i]) == 1 and ord(names[i]) >= 0x1000))]
        clash = [i for i in order if spelt[i] == end]
        self.out = self.to_id[order]
        self.final = np.array([spelt[i].endswith(end) and i not in clash for i in order])
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks={spelt[i]: r for r, i in enumerate(order)}, special_tokens={})

    def _part(self, text: str) -> tuple:
        if self.keeps_space and self.fast is not None and not _ODD.search(text):
            return self.out[self.fast.encode_to_numpy(text)].astype("<u4").tobytes(), None, None
        return super()._part(text)

    def _learn(self, memory: dict[str, bytes], missing: list[str]) -> None:
        if memory is self.pieces or self.fast is None:  # already normalised and split
            super()._learn(memory, missing)
            return
        lists = list(map(WORD_PIECES.findall, missing))
        flat = [p for x in lists for p in x]
        found = self.fast.encode_to_numpy(_END.join(flat) + _END if flat else "")
        ends = np.append(0, np.flatnonzero(self.final[found]) + 1)
        at = (4 * ends[np.append(0, np.cumsum(list(map(len, lists)), dtype=np.int64))]).tolist()
        ids = self.out[found].astype("<u4").tobytes()
        memory.update(zip(missing, (ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))


    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        if self.keeps_space or self.fast is None:
            yield from super().encode(texts)
            return
        waiting, chars = [], 0
        for text in texts:
            waiting.append(text)
            chars += len(text)
            if chars >= 4 * STEP:
                yield from self._encode_columns(waiting)
                waiting, chars = [], 0
        yield from self._encode_columns(waiting)

    def _encode_columns(self, texts: list[str]) -> Iterator[bytes]:
        """Plain texts as one column of chunks: each distinct chunk is looked up once, and
        the ids of all texts are gathered from those of the distinct chunks."""
        other = {k: t for k, t in enumerate(texts) if "<|" in t or _ODD.search(t)}
        rest = iter(list(super().encode(other.values())))
        lists = pc.ascii_split_whitespace(pa.array(["" if k in other else t.lower() for k, t in enumerate(texts)], pa.string()))
        coded = lists.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self._remember(self.cache, chunks)
        parts = list(map(self.cache.__getitem__, chunks))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        raw = ids[at].tobytes()
        bounds = (4 * np.append(0, ends)[lists.offsets.to_numpy()]).tolist()
        for k in range(len(texts)):
            yield next(rest) if k in other else raw[bounds[k] : bounds[k + 1]]


_LOADED: dict[tuple[str, type], Bpe] = {}


def load(path: str, kind: type[Bpe] = Bpe) -> Bpe:
    """The vocabulary at ``path``, once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]


def bpe_roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, left, right = [], [], []
            for ids in bpe.encode(x.as_py() for x in b.column("text")):
                n.append(len(ids) // 4)
                left.append(hashlib.sha256(ids).hexdigest())
                right.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
