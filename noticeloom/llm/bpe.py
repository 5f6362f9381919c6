"""Operator 4: BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import sliced, table
from noticeloom.llm.tokenlengths import balanced

#: Characters handled at once, and pieces whose tokens each half of a worker's memory holds.
BATCH_CHARS, MEMO = 1 << 19, 100_000
#: Pieces longer than this are not remembered, nor those whose ids are longer than the second number.
MEMO_CHARS, MEMO_IDS = 64, 128
#: Characters from which a word is merged by itself: a round goes over all of a word for one merge, which adds up.
LONG_WORD = 512
NO_RANK = np.int64(1) << 40
BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: ``str.split`` cuts here too, but the library takes these for characters of words.
NO_BLANKS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file with word ends (kind BPE of the tokenizers library), held as numpy tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.array([tokens.get(i, "") for i in range(max(tokens) + 1)], object)
        self.decimals = np.array([str(i) for i in range(len(self.tokens))], object)
        self.shown: dict[str, str] = dict(zip(self.decimals.tolist(), self.tokens.tolist(), strict=True))
        end = model["end_of_word_suffix"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + end] for c in letters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.pairs = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
        #: Ids of pieces, joined by blanks: the younger half, and the older one.
        self.ids: dict[str, str] = {}
        self.old_ids = self.ids

    def pair_ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at the places ``at``, by binary search over the sorted pair keys."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = (sym[at] << 32) | sym[after]
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[row] == key) & (word[at] == word[after]) & (at < after), self.ranks[row], NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and where each word begins in it.

        Each round merges, in every word, its pair of lowest rank, from the left, and then looks up
        the ranks of the pairs on both sides of what it merged; all others stay as they were. Words
        without a known pair leave.
        """
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum(size)
        sym = self.inner[data]
        sym[stop - 1] = self.last[data[stop - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done_sym, done_word = [], []
        rank = self.pair_ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begin)
            each = np.repeat(least, np.diff(np.r_[begin, len(sym)]))
            live = each < NO_RANK
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, each = sym[live], word[live], rank[live], each[live]
                if not len(sym):
                    break
            pos = np.flatnonzero(rank == each)
            if len(pos) > 1:  # of pairs that overlap, as in "aaa", every other one
                chain = np.r_[False, (pos[1:] == pos[:-1] + 1) & (rank[pos[1:]] == rank[pos[:-1]]) & (word[pos[1:]] == word[pos[:-1]])]
                if chain.any():
                    index = np.arange(len(pos))
                    pos = pos[(index - np.maximum.accumulate(np.where(chain, 0, index))) % 2 == 0]
            sym[pos] = self.made[rank[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            pos -= np.arange(len(pos))  # as many symbols went before each
            near = np.concatenate([pos, pos[pos > 0] - 1])
            rank[near] = self.pair_ranks(sym, word, near)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(raw)))

    def encode_long(self, word: str) -> list[int]:
        """The ids of one word by a heap of its pairs in the order of rank and place, which gives the same merges.

        Symbols are linked to their neighbours; a pair in the heap counts only if it still stands there.
        """
        data = np.frombuffer(word.encode(), np.uint8)
        sym = self.inner[data].tolist()
        sym[-1] = int(self.last[data[-1]])
        n, pairs, made = len(sym), self.pairs, self.made.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: pairs.get((sym[i] << 32) | sym[after[i]], -1) if after[i] < n else -1
        heap = [(r << 32) | i for i in range(n - 1) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if sym[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            sym[i], sym[gone], after[i] = made[r], -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := rank(j)) >= 0:
                    heapq.heappush(heap, (r << 32) | j)
        return [s for s in sym if s >= 0]

    def split(self, text: str) -> list[str]:
        """The normalised pieces between blanks, which no word crosses, and special strings with a blank before them."""
        out: list[str] = []
        parts = self.specials.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                plain = plain.lower()
                out += [p for p in BLANKS.split(plain) if p] if any(c in plain for c in NO_BLANKS) else plain.split()
        return out

    def unknown(self, pieces: set[str]) -> set[str]:
        """Those in neither half of the memory; those in the older half move to the younger."""
        new = pieces.difference(self.ids)
        for p in new & self.old_ids.keys():
            self.ids[p] = self.old_ids[p]
        return new.difference(self.ids)

    def learn(self, pieces: set[str]) -> set[str]:
        """Put the ids of unknown pieces, and of unknown words in them, into the memory; returns the pieces and the words.

        A word by itself is a piece of that one word.
        """
        ids = self.ids
        cut, single = {}, set()
        for p in pieces:
            if p[0] == " ":
                ids[p] = str(self.special[p[1:]])
            elif p.isascii() and p.isalpha():
                single.add(p)
            else:
                cut[p] = self.words.findall(p)
        todo = self.unknown(single.union(*cut.values()))
        long = [w for w in todo if len(w) >= LONG_WORD]
        short = list(todo.difference(long))
        flat, begin = self.encode_words(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own = [np.array(self.encode_long(w), np.int64) for w in long]
        bounds = np.cumsum([len(flat), *map(len, own)]).tolist()
        begin, flat = begin.tolist() + bounds[:-1], np.concatenate([flat, *own])
        decimals = self.decimals[flat].tolist()
        for w, a, b in zip(short + long, begin, [*begin, len(flat)][1:], strict=True):
            ids[w] = " ".join(decimals[a:b])
        for p, words in cut.items():
            if len(words) > 1:
                ids[p] = " ".join([ids[w] for w in words])
        return todo | pieces

    def forget(self, learned: set[str]) -> None:
        """Drop what is long of that just learned, the older half once the younger is full, and both after a text of very many pieces."""
        for p in learned:
            if len(p) > MEMO_CHARS or len(self.ids[p]) > MEMO_IDS:
                del self.ids[p]
        if len(self.ids) > MEMO:
            self.old_ids = self.ids if len(self.ids) <= 2 * MEMO else {}
            self.ids = {}

    def forget_all(self) -> None:
        """Drop both halves: a worker that waits for tasks of any kind keeps no pieces."""
        self.ids = self.old_ids = {}

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text the number of tokens, the decimal ids and the decoded text."""
        for part in balanced([len(t or "") for t in texts], BATCH_CHARS):
            cut = [self.split(t) if t else [] for t in texts[part]]
            learned = self.learn(self.unknown(set().union(*cut)))
            coded = [" ".join(map(self.ids.__getitem__, pieces)) for pieces in cut]
            self.forget(learned)
            del cut, learned
            for own in coded:
                ids = own.split()
                yield len(ids), own, " ".join(map(self.shown.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, with ``ids`` and ``decoded`` on demand.

    A null text counts as empty, an empty one has no tokens. The file has no decoder, so that
    decoding joins the tokens, word ends shown, by blanks. A very long text is a batch of its own, and a very
    long word in it is merged by itself in time that grows little faster than its length. Repeated
    rows and ids are encoded each, a null id stays; other columns play no part, whatever their names;
    an empty table gives no rows. Pieces are remembered for one task only, as its worker serves other stages after it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            word_bpe(path).forget_all()
            pa.default_memory_pool().release_unused()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in sliced(batches):
            n, a, b, ids, decoded = [], [], [], [], []
            for count, own, text in bpe.encode_batch(batch.column("text").to_pylist()):
                n.append(count)
                a.append(hashlib.sha256(own.encode()).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
                if with_text:
                    ids.append([int(i) for i in own.split()])
                    decoded.append(text)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_text:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_text else ""
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
