"""Pack token sequences: documents go to tiers by length, long windows are closed with shorter tiers' pieces."""

from __future__ import annotations

import bisect
import heapq
import zlib

from pyspark.sql import DataFrame, SparkSession

from cladeworks.llm import tokens
from cladeworks.llm.common import few, table, texts

#: Context sizes, and the tokens of the steps among which a task's sequences are balanced.
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 64 * 2048
#: Tokens that a task gathers before it packs them.
HELD = 4 << 20


class _Pool:
    """Items (length, number, start) of one tier, taken by best fit."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def add(self, item):
        bisect.insort(self.items, item)

    def longest(self, most: int):
        i = bisect.bisect_right(self.items, (most, 1 << 62, 0))
        return self.items.pop(i - 1) if i else None


def _tier(length: int) -> int:
    return min(t for t in TIERS if t >= length)


def pack(lengths: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length), each as long as a tier, and the pieces left, shorter than the shortest.

    Whole long windows are cut off first. What remains of an item waits in the tier that it fits. From the longest
    tier down, each item opens a window; its gap takes the longest item that fits from that tier and the shorter
    ones, and is closed with the head of the next item, whose rest goes back to the tier that it fits.
    """
    pools, done = {t: _Pool() for t in TIERS}, []
    for k, n in enumerate(lengths):
        whole = n // TIERS[0]
        done += [[(k, i * TIERS[0], TIERS[0])] for i in range(whole)]
        if rest := n - whole * TIERS[0]:
            pools[_tier(rest)].add((rest, k, n - rest))
    left: list[tuple[int, int, int]] = []
    for at, size in enumerate(TIERS):
        below = TIERS[at:]
        while pools[size].items:
            n, k, start = pools[size].items.pop()
            window, gap = [(k, start, n)], size - n
            while gap:
                if item := next((x for t in below if (x := pools[t].longest(gap))), None):
                    window.append((item[1], item[2], item[0]))
                    gap -= item[0]
                    continue
                source = next((t for t in reversed(below) if pools[t].items), None)
                if source is None:
                    break
                n, k, start = pools[source].items.pop(0)
                window.append((k, start, gap))
                pools[_tier(n - gap)].add((n - gap, k, start + gap))
                gap = 0
            if not gap:
                done.append(window)
                continue
            for smaller in [t for t in TIERS if t < size]:  # no more items: what there is fills shorter windows
                if size - gap >= smaller:
                    head, window = _cut(window, smaller)
                    done.append(head)
                    gap += smaller
            left += window
    return done, left


def _cut(window: list[tuple[int, int, int]], size: int):
    head, rest = [], []
    for k, start, n in window:
        take = min(n, size)
        head += [(k, start, take)] * bool(take)
        rest += [(k, start + take, n - take)] * (n > take)
        size -= take
    return head, rest


def tail(left: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces left at the end of a task, in sequences that are powers of two, longest first: these take no padding."""
    out, n = [], sum(x[2] for x in left)
    while n:
        size = 1 << n.bit_length() - 1
        head, left = _cut(left, size)
        out.append(head)
        n -= size
    return out


def balance(sizes: list[int]) -> list[int]:
    """A step for each sequence: longest first, each to the step with the least attention cost so far."""
    steps = max(1, round(sum(sizes) / STEP_TOKENS))
    cost, out = [(0, 0, s) for s in range(steps)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        c, n, s = heapq.heappop(cost)
        out[i] = s
        heapq.heappush(cost, (c + sizes[i] ** 2, n + 1, s))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step long"


def _pack(path: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from cladeworks.llm.common import raw

        number = step = TaskContext.get().partitionId() << 40
        ids: list[bytes] = []  # of the items at hand, cut off what went before
        docs: list[tuple] = []  # (doc_id, tokens of the document, start of the item in it)

        def emit(sequences):
            nonlocal number, step
            rows = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            at = balance([sum(x[2] for x in s) for s in sequences])
            for s, own in zip(sequences, at, strict=True):
                offset, size = 0, sum(x[2] for x in s)
                for k, start, n in s:
                    doc, total, before = docs[k]
                    for c, v in zip(rows, (doc, before + start, n, zlib.crc32(ids[k][4 * start : 4 * (start + n)]), total, number, offset, size, step + own), strict=True):
                        rows[c].append(v)
                    offset += n
                number += 1
            step += max(at, default=-1) + 1
            return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in rows.items()})

        held = 0
        for b in few(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
                ids.append(tokens.encode(text, path))
                docs.append((doc, len(ids[-1]) // 4, 0))
                held += docs[-1][1]
                if held >= HELD:
                    done, left = pack([len(x) // 4 for x in ids])
                    yield emit(done)
                    docs = [(docs[k][0], docs[k][1], docs[k][2] + start) for k, start, n in left]
                    ids = [ids[k][4 * start : 4 * (start + n)] for k, start, n in left]
                    held = sum(n for _, _, n in left)
        done, left = pack([len(x) // 4 for x in ids])
        yield emit(done + tail(left))

    return run


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each piece: where it lies in its document and in which sequence.

    Every token of every document (null text: only the end id) lies in exactly one piece. Each scan task packs the
    documents that it reads, so no text or token is shuffled; a task that is run again gives the same pieces.
    Sequences hold exactly 2048, 1024, 512 or 256 tokens (the tier); of each task's last tokens, fewer than 256,
    shorter powers of two are made. Steps hold sequences of one task with like costs. Repeated rows are packed each;
    texts of any length are cut into as many windows as they fill; an empty table gives none; other columns are left behind.
    """
    return texts(docs).select("doc_id", "text").mapInArrow(_pack(tokenizer), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences; cases as in ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), tokens.default_path())
