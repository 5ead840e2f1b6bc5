"""BPE encoding by a minimal acyclic transducer of frequent pre-tokens; unseen ones are merged exactly.

The most frequent pre-tokens of the corpus (``LEXICON`` of them, counted over all documents) are compiled into an
automaton over bytes that shares suffixes as well as prefixes.  Each transition carries the number of accepted words that
sort before its subtree, so the sum along a path is the word's rank, which points into the table of id lists.  The
compiled arrays are one flat buffer of bounded size; a worker maps it from an unlinked temporary file and looks up
a whole batch of pre-tokens at once, one byte of all of them a step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, slices, stored, work_dir
from tidemark.llm.tokens import OTHERS, PIECES, SPECIAL, Known, byte_of_char, is_plain, library, pieces_of, vocabulary_path

LEXICON = 1 << 15
MOST_KNOWN = 400_000
MARK = "\x00"
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62


class Merges:
    """The vocabulary file's byte tokens and merge ranks; exact merging of one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        raw = byte_of_char()
        vocab = model["model"]["vocab"]
        self.id_of = {bytes(raw[c] for c in t): i for t, i in vocab.items() if all(c in raw for c in t)}
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = added[SPECIAL]
        for content, i in added.items():
            self.id_of.pop(content.encode(), None)
        self.bytes_of = [b""] * (max(max(vocab.values()), *added.values()) + 1)
        for t, i in self.id_of.items():
            self.bytes_of[i] = t
        for content, i in added.items():
            self.bytes_of[i] = content.encode()
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        # left id and right id in one integer -> rank and merged id in one integer
        self.rank: dict[int, int] = {}
        for n, m in enumerate(model["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = (bytes(raw[c] for c in x) for x in (left, right))
            self.rank[self.id_of[a] << BITS | self.id_of[b]] = n << BITS | self.id_of[a + b]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: again and again the adjacent pair of lowest rank, leftmost first."""
        ids = [self.single[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank = self.rank.get
        pairs = [rank(a << BITS | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == NONE:
                break
            i = pairs.index(low)
            ids[i : i + 2] = [low & MASK]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(ids[i - 1] << BITS | ids[i], NONE)
            if i < len(pairs):
                pairs[i] = rank(ids[i] << BITS | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for pre-tokens without an end in sight."""
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self.rank.get(ids[i] << BITS | ids[after[i]], NONE)) != NONE:
                heapq.heappush(heap, (found >> BITS, i, ids[i], ids[after[i]], found & MASK))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x is not None]


def build(words: dict[bytes, list[int]]) -> bytes:
    """The compiled lexicon: sizes, then the arrays keys, targets, skips (by edge), accepts (by state), offsets, ids."""
    ranked = sorted(words)
    root: dict = {"next": {}, "end": False}
    register: dict[tuple, dict] = {}
    path: list[tuple[dict, int]] = []
    last = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte = path.pop()
            child = parent["next"][byte]
            key = (child["end"], tuple((b, id(t)) for b, t in child["next"].items()))
            parent["next"][byte] = register.setdefault(key, child)

    for w in ranked:
        same = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
        settle(same)
        node = path[-1][0]["next"][path[-1][1]] if path else root
        for b in w[same:]:
            node["next"][b] = {"next": {}, "end": False}
            path.append((node, b))
            node = node["next"][b]
        node["end"] = True
        last = w
    settle(0)
    number, order = {id(root): 0}, [root]
    for node in order:  # the list grows while it is walked: breadth first
        for t in node["next"].values():
            if id(t) not in number:
                number[id(t)] = len(order)
                order.append(t)
    size: dict[int, int] = {}

    def words_below(top: dict) -> int:
        stack = [top]
        while stack:
            node = stack[-1]
            todo = [t for t in node["next"].values() if id(t) not in size]
            if todo:
                stack.extend(todo)
            else:
                size[id(node)] = node["end"] + sum(size[id(t)] for t in node["next"].values())
                stack.pop()
        return size[id(top)]

    words_below(root)
    edges = []
    for node in order:
        skip = int(node["end"])
        for b in sorted(node["next"]):
            t = node["next"][b]
            edges.append((number[id(node)] * 256 + b, number[id(t)], skip))
            skip += size[id(t)]
    edges.sort()
    lists = [words[w] for w in ranked]
    arrays = [
        np.array([e[0] for e in edges], np.int64),
        np.array([e[1] for e in edges], np.int64),
        np.array([e[2] for e in edges], np.int64),
        np.array([n["end"] for n in order], np.int64),
        np.cumsum([0, *map(len, lists)]).astype(np.int64),
        np.array([i for x in lists for i in x], np.int64),
    ]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Look-ups in a compiled lexicon, memory-mapped."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, arrays = np.frombuffer(self.map, np.int64, 6), 48, []
        for n in sizes.tolist():
            arrays.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.targets, self.skips, self.ends, self.offsets, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 where it is not in it."""
        rank = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return rank
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        live, state, total, depth = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            over = size[live] == depth
            done = over & (self.ends[state] > 0)
            rank[live[done]] = total[done]
            live, state, total = live[~over], state[~over], total[~over]
            key = state * 256 + raw[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, total = self.targets[at], total[hit] + self.skips[at]
            depth += 1
        return rank

    def packed(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].astype("<u4").tobytes()


def pretokens(text: str | None, path: str) -> list[str]:
    """The pre-tokens of a text; the vocabulary's special string stays whole."""
    if not text:
        return []
    if SPECIAL in text:
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL] * (i > 0) + pretokens(part, path)
        return out
    if OTHERS.search(text):
        raw = byte_of_char()
        return [bytes(raw[c] for c in w).decode() for w, _ in library(path).pre_tokenizer.pre_tokenize_str(text)]
    return PIECES.findall(text)


def cuts(text: str | None, path: str) -> list[str]:
    """Parts of a text that pre-tokens do not cross: a plain text is cut before each blank and line feed, any other into pre-tokens.

    The first part of a plain text and the parts of any other begin with a NUL; the rest have lost a blank or begin with a line feed.
    """
    if text and MARK not in text and is_plain(text):
        first, *rest = text.replace("\n", " \n").split(" ")
        return [MARK + first, *rest]
    return [MARK + w for w in pretokens(text, path)]


def pretokens_of_cut(cut: str) -> list[str]:
    """The pre-tokens of a cut: whole where it is marked and no plain text, else by the split rule."""
    if cut[:1] == MARK:
        return [cut[1:]] if not is_plain(cut[1:]) else PIECES.findall(cut[1:])
    return pieces_of(cut)


class Coder:
    """A worker's encoder: known cuts first, then known pre-tokens, then the lexicon, then exact merging."""

    def __init__(self, path: str, data: bytes):
        self.path, self.merges, self.lexicon = path, Merges(path), Lexicon(data)
        self.known, self.whole = Known(None), Known(None)
        self.bytes_of = np.array(self.merges.bytes_of, object)

    def _new(self, table: Known, keys: set[str]) -> list[str]:
        """Keys that a table has not; those of its last generation come over."""
        keys = keys - table.keys()
        back = keys & table.old.keys()
        table.update((k, table.old[k]) for k in back)
        return list(keys - back)

    def learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        for word, b, rank in zip(new, raw, self.lexicon.ranks(raw).tolist(), strict=True):
            if word == SPECIAL:
                self.known[word] = self.pack[1](self.merges.special)
            elif rank >= 0:
                self.known[word] = self.lexicon.packed(rank)
            else:
                ids = self.merges.merge(b)
                self.known[word] = self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, "<u4").tobytes()

    pack = tuple(struct.Struct(f"<{n}I").pack for n in range(32))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [cuts(t, self.path) for t in texts]
        new = {c: pretokens_of_cut(c) for c in self._new(self.whole, set().union(*split))}
        self.learn(self._new(self.known, set().union(*new.values())))
        get = self.known.__getitem__
        self.whole.update((c, b"".join(map(get, x))) for c, x in new.items())
        out = [b"".join(map(self.whole.__getitem__, x)) for x in split]
        self.known.age(MOST_KNOWN)
        self.whole.age(MOST_KNOWN)
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(self.bytes_of[np.frombuffer(packed, "<u4")].tolist()).decode("utf-8", "replace")


def coder(path: str, data: bytes, digest: str) -> Coder:
    """The worker's coder of this lexicon."""
    return held(f"coder {digest}", lambda: Coder(path, data))


def count_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): occurrences of each pre-token in all texts; counts are combined in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for cut, n in seen.items():
                for w in pretokens_of_cut(cut):
                    words[w] += n
            seen.clear()
            return pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for t in part["text"].to_pylist():
                    seen.update(cuts(t, path))
                if len(seen) > 2 * MOST_KNOWN:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> bytes:
    """The lexicon of the most frequent pre-tokens of ``docs``, ``size`` at most.

    A histogram of counts, eight steps to a doubling, says from which count on there are at most ``size`` of them; only those rows
    reach the driver.
    """
    words = stored(count_pretokens(docs, path).where((F.col("n") > 1) & (F.length("word") <= 64)), work_dir(docs.sparkSession))
    step = F.floor(F.log2("n") * 8).alias("step")
    total, least = 0, None
    for r in sorted(words.groupBy(step).count().collect(), reverse=True):  # a few hundred rows at any corpus size
        total += r["count"]
        if total > size:
            break
        least = r["step"]
    top = words.where(step >= least).collect() if least is not None else []
    merges = Merges(path)
    return build({w: merges.merge(w) for w in (r["word"].encode() for r in top) if w != SPECIAL.encode()})


def encode_texts(docs: DataFrame, vocabulary: str | None = None, size: int = LEXICON) -> DataFrame:
    """(doc_id, ids, decoded): packed uint32 ids of every text and the text decoded from them.

    Null and empty texts have no ids and decode to the empty string; texts of any length are encoded whole.  Words as frequent as each other
    enter the lexicon in the order of their text, which no id depends on.  Repeated rows are encoded each; a null doc_id is carried; an
    empty table gives no rows.  Other columns are not read.
    """
    path = vocabulary or vocabulary_path()
    data = compile_lexicon(docs, path, size)
    digest = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, shared.value, digest)
        for batch in batches:
            for part in slices(batch):
                ids = c.encode(part["text"].to_pylist())
                yield pa.record_batch(
                    [part["doc_id"], pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
