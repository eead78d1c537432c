"""Byte-level BPE over whole batches, with a minimal acyclic transducer for frequent words.

Texts are cut into pre-tokens by character classes laid out as arrays. Each distinct pre-token of a block is looked up once:
frequent words in the transducer (states shared by common suffixes; the numbers on a path add up to the word's row in the
id table), all others by exact merging in rank order. The transducer file is mapped into memory by every task, so the tasks of
an executor share one copy.

Defined cases: null text counts as empty and has no ids; the tokenizer's added tokens inside a text get their own id, as the
library does; texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from transitloom.llm.text import groups, raw_texts, span_hashes, tidy, whole_texts
from transitloom.session import cut

BLOCK = 1 << 20
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 48
CACHE_WORDS = 150_000
LETTER, NUMBER, OTHER, BLANK, UNKNOWN = 0, 1, 2, 3, 255


def _byte_letters() -> dict[str, int]:
    """Byte of each letter that stands for one in the vocabulary: printable bytes for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array, in the order asked for, as (flat, offsets)."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)], ends


class Bpe:
    """Vocabulary, merges and character classes of a byte-level BPE file (its JSON text)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        special = {t["content"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        for content, i in self.added.items():
            raw[i] = content
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.single = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs = keys[order]
        self.rank = order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        self.merged = self.joined[order]
        self._tokenizer = source
        self._classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._asked = None

    # Character classes, as the tokenizer itself splits them.
    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self._classes[points]
        if (found == UNKNOWN).any():
            if self._asked is None:
                from tokenizers import Tokenizer

                self._asked = Tokenizer.from_str(self._tokenizer).pre_tokenizer
            for p in np.unique(points[found == UNKNOWN]).tolist():
                c = chr(p)
                starts = {at for _, (at, _) in self._asked.pre_tokenize_str(f"a{c}1")}
                if 1 not in starts:
                    kind = LETTER
                elif 2 not in starts and c != " ":
                    kind = NUMBER
                else:
                    kind = OTHER if 1 not in {at for _, (at, _) in self._asked.pre_tokenize_str(f"!{c}a")} else BLANK
                self._classes[p] = kind
            found = self._classes[points]
        return found

    def starts(self, buf: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """First byte of every pre-token. ``texts``: first byte of each non-empty text; a text ends where the next begins."""
        n = len(buf)
        kind = self.classes(np.minimum(buf, 127).astype(np.int64)) if n else np.zeros(0, np.uint8)
        lead = np.flatnonzero(buf >= 0xC0)
        char = (buf & 0xC0) != 0x80
        if len(lead):
            b = buf[lead].astype(np.int64)
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            follow = [np.where(size > k, buf[np.minimum(lead + k, n - 1)] & 0x3F, 0).astype(np.int64) for k in (1, 2, 3)]
            point = np.where(size == 2, (b & 0x1F) << 6 | follow[0], np.where(size == 3, (b & 0x0F) << 12 | follow[0] << 6 | follow[1], (b & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]))
            own = self.classes(point)
            for k in range(4):
                kind[lead[size > k] + k] = own[size > k]
        first = np.zeros(n + 1, dtype=bool)
        first[texts] = True
        start = np.ones(n, dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= first[:n]
        # The last blank before a word begins a pre-token: a space together with the word, another blank alone.
        begins = np.flatnonzero(start & (kind != BLANK))
        begins = begins[(begins > 0) & ~first[begins]]
        after = begins[kind[begins - 1] == BLANK]
        last = after - 1
        for _ in range(3):  # back to the first byte of that blank
            last = np.where(char[last], last, last - 1)
        start[last] = True
        start[after[buf[after - 1] == 32]] = False
        # Contractions, where an apostrophe begins a pre-token.
        quote = np.flatnonzero(start & (buf == 39))
        for suffix in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            ok = quote + len(suffix) < n
            for k, c in enumerate(suffix, 1):
                at = np.minimum(quote + k, n - 1)
                ok &= (buf[at] == c) & ~first[at]
            start[quote[ok] + 1] = False
            ends = quote[ok] + 1 + len(suffix)
            start[ends[ends < n]] = True
        return np.flatnonzero(start)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by exact merging: always the pair of lowest rank, leftmost first."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size > 64:
                for i in rows.tolist():
                    out[i] = self._merge_long(words[i])
                continue
            ids = self.single[np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8).reshape(len(rows), size)]
            for i, own in zip(rows.tolist(), self._merge_equal(ids)):
                out[i] = own
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, ok = _lookup(self.pairs, left << 32 | right)
        return np.where(ok, self.rank[at], len(self.pairs))

    def _merge_equal(self, ids: np.ndarray) -> list[np.ndarray]:
        none, out, rows = len(self.pairs), [None] * len(ids), np.arange(len(ids))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if ids.shape[1] == 1:
                open_ = np.zeros(len(ids), dtype=bool)
            else:
                best = rank.argmin(axis=1)
                open_ = rank[np.arange(len(ids)), best] < none
            for i, own in zip(rows[~open_].tolist(), ids[~open_]):
                out[i] = own
            if not open_.any():
                return out
            ids, rank, rows, best = ids[open_], rank[open_], rows[open_], best[open_]
            # The rank of a pair names what it becomes, so only the pairs that are new get looked up.
            n, width, line = len(ids), ids.shape[1] - 1, np.arange(len(ids))
            joined = self.joined[rank[line, best]]
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, best + 1] = False
            ids = ids[keep].reshape(n, width)
            ids[line, best] = joined
            if width > 1:
                keep = np.ones(rank.shape, dtype=bool)
                keep[line, best] = False
                rank = rank[keep].reshape(n, width - 1)
                right, left = np.flatnonzero(best < width - 1), np.flatnonzero(best > 0)
                row, at = np.append(right, left), np.append(best[right], best[left] - 1)
                rank[row, at] = self._ranks(ids[row, at], ids[row, at + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(word, np.uint8)]
        n, none = len(ids), len(self.pairs)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._ranks(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks.tolist()) if r < none]
        heapq.heapify(heap)
        now, ids, alive = ranks.tolist() + [none], ids.tolist(), [True] * n
        table = self._table()
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or now[i] != r:
                continue
            j = after[i]
            ids[i] = table[(ids[i], ids[j])][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = table.get((ids[k], ids[after[k]]), (none,))[0] if after[k] < n else none
                    if now[k] < none:
                        heapq.heappush(heap, (now[k], k))
        return np.array([x for x, a in zip(ids, alive) if a], dtype=np.int64)

    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pair_table"):
            self._pair_table = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(self.pairs.tolist(), self.rank.tolist(), self.merged.tolist())}
        return self._pair_table

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.bytes, self.byte_at, ids)[0].tobytes().decode("utf-8", errors="replace")


class Transducer:
    """Word to ids, as a minimal acyclic automaton in one file: sorted arcs (state, byte) with target and number."""

    PARTS = (("keys", np.int64), ("target", np.int64), ("number", np.int64), ("final", np.int64), ("ids", np.int64), ("offsets", np.int64))

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.int64, mode="r")
        sizes, at = data[: len(self.PARTS)].tolist(), len(self.PARTS)
        for (name, _), size in zip(self.PARTS, sizes):
            setattr(self, name, data[at : at + size])
            at += size

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each word in the id table, -1 for words that are not in it."""
        n = len(starts)
        state, number, row = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, dtype=np.int64)
        live, step = np.arange(n), 0
        if len(self.keys) == 0:
            return row
        while len(live):
            at_end = starts[live] + step == ends[live]
            done = live[at_end]
            ok = self.final[state[done]] == 1
            row[done[ok]] = number[done[ok]]
            live = live[~at_end]
            at, hit = _lookup(self.keys, state[live] << 8 | buf[starts[live] + step])
            live, at = live[hit], at[hit]
            number[live] += self.number[at]
            state[live] = self.target[at]
            step += 1
        return row

    @classmethod
    def build(cls, words: list[bytes], ids: list[np.ndarray], path: str) -> None:
        """Compiles words (sorted, distinct) by adding them in order and merging finished states with equal futures."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        trail: list[int] = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(trail) > depth + 1:
                s = trail.pop()
                key = (final[s], *arcs[s].items())
                same = register.setdefault(key, s)
                arcs[trail[-1]][last[len(trail) - 1]] = same

        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            settle(common)
            last = word
            for b in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[trail[-1]][b] = len(arcs) - 1
                trail.append(len(arcs) - 1)
            final[trail[-1]] = True
        settle(0)
        order, place, stack = [], {0: 0}, [0]
        while stack:  # states that are left, numbered as they are met
            s = stack.pop()
            order.append(s)
            for t in arcs[s].values():
                if t not in place:
                    place[t] = len(place)
                    stack.append(t)
        counts: dict[int, int] = {}
        todo = [(0, False)]
        while todo:
            s, ready = todo.pop()
            if s in counts:
                continue
            if ready:
                counts[s] = final[s] + sum(counts[t] for t in arcs[s].values())
            else:
                todo.append((s, True))
                todo.extend((t, False) for t in arcs[s].values())
        rows = []
        for s in order:
            before = int(final[s])
            for b in sorted(arcs[s]):
                rows.append((place[s] << 8 | b, place[arcs[s][b]], before))
                before += counts[arcs[s][b]]
        rows.sort()
        ends = np.zeros(len(order), dtype=np.int64)
        ends[[place[s] for s in order if final[s]]] = 1
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        parts = [table[:, 0], table[:, 1], table[:, 2], ends, np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])])]
        np.concatenate([[len(p) for p in parts], *parts]).astype(np.int64).tofile(path)


class Encoder:
    """Encodes Arrow columns of texts; lives in one worker process, where later tasks find it again (``encoder``)."""

    def __init__(self, bpe: Bpe, transducer: Transducer | None = None) -> None:
        self.bpe, self.transducer = bpe, transducer
        self.seen: dict[bytes, np.ndarray] = {}

    def pieces(self, texts: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
        """Texts cut at added tokens: (piece, text it belongs to, id of an added token or -1)."""
        out, owner, fixed = [], [], []
        for i, t in enumerate(texts):
            todo = [(t, -1)]
            for content, token in self.bpe.added.items():
                if content in t:
                    todo = [y for x, k in todo for y in ([(x, k)] if k >= 0 else [z for j, p in enumerate(x.split(content)) for z in ([(content, token)] if j else []) + [(p, -1)]])]
            for x, k in todo:
                if x:
                    out.append(x)
                    owner.append(i)
                    fixed.append(k)
        return out, owner, fixed

    def words(self, texts: list[bytes]):
        """(buffer, first and last byte of each pre-token, its text, id of an added token or -1)."""
        parts, owner, fixed = self.pieces(texts)
        buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        starts = self.bpe.starts(buf, at[:-1]) if len(buf) else np.zeros(0, np.int64)
        fixed_at = np.array(fixed, dtype=np.int64)
        if (fixed_at >= 0).any():  # an added token is one pre-token
            mark = np.ones(len(starts), dtype=bool)
            for k in np.flatnonzero(fixed_at >= 0):
                mark[(starts > at[k]) & (starts < at[k + 1])] = False
            starts = starts[mark]
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        part = np.searchsorted(at, starts, side="right") - 1
        return buf, starts, ends, np.array(owner, dtype=np.int64)[part], fixed_at[part]

    def block(self, texts: list[bytes]) -> list[np.ndarray]:
        buf, starts, ends, owner, fixed = self.words(texts)
        if not len(starts):
            return [np.zeros(0, np.int64) for _ in texts]
        _, first, word = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        rows = self.transducer.find(buf, starts[first], ends[first]) if self.transducer else np.full(len(first), -1, np.int64)
        rows[fixed[first] >= 0] = -1
        known, unseen = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        raw = buf.tobytes()
        spelled = [raw[a:b] for a, b in zip(starts[first[unseen]].tolist(), ends[first[unseen]].tolist())]
        new = [w for w in spelled if w not in self.seen]
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = spelled
        self.seen.update(zip(new, self.bpe.merge(new)))
        own = [self.seen[w] for w in spelled]
        for i in np.flatnonzero(fixed[first[unseen]] >= 0).tolist():
            own[i] = fixed[first[unseen[i]]][None]
        flat, at = gather(self.transducer.ids, self.transducer.offsets, rows[known]) if len(known) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        flat = np.concatenate([flat, *own])
        at = np.concatenate([at, at[-1] + np.cumsum([len(x) for x in own], dtype=np.int64)])
        place = np.empty(len(first), dtype=np.int64)
        place[known], place[unseen] = np.arange(len(known)), len(known) + np.arange(len(unseen))
        ids, ends_at = gather(flat, at, place[word])
        limits = ends_at[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return [ids[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for texts in text_blocks(column):
            yield from self.block(texts)


def text_blocks(column: pa.Array) -> Iterator[list[bytes]]:
    for _, texts in groups(column, BLOCK, 1024):
        yield texts


def load_source(df: DataFrame, tokenizer: str):
    """The tokenizer file (``tokenizer`` is its path on the driver) as a broadcast text; about 1.5 MB."""
    whole_texts(df)
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _count_words(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(source)
        for batch in batches:
            for texts in text_blocks(batch.column(0)):
                buf, starts, ends, _, fixed = tool.words(texts)
                short = (ends - starts <= LEXICON_BYTES) & (fixed < 0)
                starts, ends = starts[short], ends[short]
                if len(starts):
                    _, first, n = np.unique(span_hashes(buf, starts, ends), return_index=True, return_counts=True)
                    raw = buf.tobytes()
                    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return tidy(run)


def frequent_words(docs: DataFrame, source, size: int = LEXICON_WORDS) -> list[bytes]:
    """About the ``size`` most frequent words of all texts.

    Counts of words per level of frequency (a few hundred) tell where to cut, so only the words wanted leave their tasks: at most
    ``size`` from whole levels, and from the level that does not fit a share by hash, ``size`` in all but for its chance deviation.
    """
    counted = docs.select("text").mapInArrow(_count_words(source), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.where("n > 1").withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    levels = {r["level"]: r["c"] for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("c")).collect()}
    room, whole, share = size, [], F.lit(False)
    for level in sorted(levels, reverse=True):
        if levels[level] > room:
            place = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
            share = (F.col("level") == level) & (place < int((1 << 30) * room / levels[level]))
            break
        room -= levels[level]
        whole.append(level)
    return sorted(bytes(r["word"]) for r in counted.where(F.col("level").isin(whole) | share).select("word").collect())


def compile_lexicon(docs: DataFrame, source, size: int = LEXICON_WORDS) -> str:
    """Builds the transducer and hands it to all executors; returns its file name for ``SparkFiles``."""
    words = frequent_words(docs, source, size)
    folder = tempfile.mkdtemp(prefix="lexicon-")  # on the driver only; Spark serves the file to each executor
    path = os.path.join(folder, f"lexicon-{hashlib.sha256(os.urandom(16)).hexdigest()[:16]}.bin")
    Transducer.build(words, Bpe(source.value).merge(words), path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


_ENCODERS: dict[tuple, Encoder] = {}  # of this worker process


def encoder(source, lexicon: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer and a lexicon; built once a process, so tasks share its tables and the words seen."""
    key = (hashlib.sha256(source.value.encode()).digest(), lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()  # one at a time: memory stays as that of a single task
        _ENCODERS[key] = Encoder(Bpe(source.value), Transducer(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[key]


def _encode(source, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(source, lexicon)
        for batch in batches:
            ids = pa.array([x.astype(np.int32) for x in tool.column(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return tidy(run)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """id, ids (array of int) of every row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = load_source(docs, tokenizer)
    lexicon = compile_lexicon(narrow, source, size)
    return narrow.mapInArrow(_encode(source, lexicon), f"id {narrow.schema['id'].dataType.simpleString()}, ids array<int>")


def _decode(source, lexicon=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(source, lexicon).bpe
        for batch in batches:
            at, column = 0, batch.column(1)
            texts = []
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for at in range(batch.num_rows):
                texts.append(bpe.decode(flat[offsets[at] : offsets[at + 1]].astype(np.int64)) if column[at].is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tidy(run)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """id, text of rows (id, ids); null ids give a null text."""
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(_decode(load_source(encoded, tokenizer)), f"id {kind}, text string")


@tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        flat, offsets = column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
        digests = [hashlib.sha256(",".join(map(str, flat[a:b])).encode()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        decoded = [hashlib.sha256(t).hexdigest() for t in raw_texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(column.offsets.to_numpy()).astype(np.int64)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _chain(*steps):
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return tidy(run)


def _both(source, lexicon):
    """Keeps the ids next to the decoded text, batch by batch."""
    step = _decode(source, lexicon)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                part = pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1).to_numpy(zero_copy_only=False), pa.list_(pa.int32()))], names=["id", "ids"])
                for text in step(iter([part])):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text.column(1)], names=["id", "ids", "text"])

    return tidy(run)


def roundtrip_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encoded, decoded from the ids, and digested where the ids are: no token leaves its task."""
    narrow = docs.select(F.col("doc_id").alias("id"), "text")
    source = load_source(docs, tokenizer)
    lexicon = compile_lexicon(narrow, source)
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_chain(_encode(source, lexicon), _both(source, lexicon), _digest), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
