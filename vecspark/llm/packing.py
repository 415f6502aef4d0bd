"""Vector bin packing of examples into training sequences.

An example's demand is a vector: tokens, segments (one), and tokens that bear loss. A sequence has a limit for each. The
open sequence takes the example whose demand has the largest dot product with what the sequence has left, each dimension
as a share of its limit and weighted by the mean demand on it, among the examples that fit; when none fits, the sequence
is closed. Where examples may be cut, stretches of a whole sequence are cut off first, and what is left open at closing is
filled with the head of one more example; a sequence that still ends short is divided at powers of two, which need no
padding.

Packing runs within a task, block by block of BLOCK_TOKENS tokens, and nothing is shuffled; an unfinished sequence is
carried into the next block. Examples of equal demand form one class, so a choice costs one pass over the classes.

Nulls: a null text is an empty one and has the end id only; a null prompt length is 0. Repeated rows are packed one by one.
An empty table gives an empty result. Columns other than doc_id, text and the prompt length are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import bounded_batches, small_batches, text_of, texts

BLOCK_TOKENS = 2_000_000
#: Sequences of one task: the task's number is above these bits of sequence_id.
SEQUENCE_BITS = 36
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs items (key, start, tokens, leading tokens without loss) under limits (tokens, segments, loss tokens)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool):
        self.limits, self.cut = np.array(limits, np.float64), cut
        self.classes: dict[tuple[int, int], int] = {}
        self.members: list[list[tuple]] = []
        self.demand = np.zeros((64, 3))
        self.count = np.zeros(64, np.int64)

    def add(self, key, start: int, tokens: int, quiet: int) -> None:
        at = self.classes.setdefault((tokens, tokens - quiet), len(self.members))
        if at == len(self.members):
            self.members.append([])
            if at == len(self.demand):
                self.demand, self.count = np.vstack((self.demand, np.zeros_like(self.demand))), np.concatenate((self.count, np.zeros_like(self.count)))
            self.demand[at] = tokens, 1, tokens - quiet
        self.members[at].append((key, start, tokens, quiet))
        self.count[at] += 1

    def _take(self, at: int) -> tuple:
        self.count[at] -= 1
        return self.members[at].pop()

    def sequences(self) -> Iterator[tuple[list[tuple], bool]]:
        """Each sequence's items in order, and whether it was closed because nothing fits (else only for want of items)."""
        n = len(self.members)
        demand, count = self.demand[:n], self.count
        total = (demand * count[:n, None]).sum(0)
        weight = total / max(1, count[:n].sum()) / self.limits**2
        while True:
            n = len(self.members)
            demand, count = self.demand[:n], self.count[:n]
            if not count.any():
                return
            room, inside = self.limits.copy(), []
            while True:
                score = demand @ (weight * room)
                score[(count == 0) | (demand > room).any(1)] = -1
                best = int(score.argmax())
                if score[best] <= 0:
                    break
                inside.append(self._take(best))
                room -= demand[best]
            left = count.any()
            if left and self.cut and room[0] >= 1 and room[1] >= 1 and room[2] >= 1:
                # No item fits whole, so each has more tokens or more loss than there is room for.
                longest = int(np.where(count > 0, demand[:, 0], -1).argmax())
                key, start, tokens, quiet = self._take(longest)
                head = int(min(room[0], quiet + room[2], tokens))
                inside.append((key, start, head, min(quiet, head)))
                if tokens > head:
                    self.add(key, start + head, tokens - head, max(0, quiet - head))
            if not inside:
                raise ValueError(f"an example of {demand[count > 0][0].astype(int).tolist()} tokens, segments and loss tokens exceeds the limits")
            yield inside, bool(left)


def at_powers(items: list[tuple]) -> Iterator[list[tuple]]:
    """The items as sequences of 2^a, 2^b, ... tokens, longest first."""
    total, items = sum(x[2] for x in items), list(items)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        inside = []
        while want:
            key, start, tokens, quiet = items.pop(0)
            head = min(want, tokens)
            inside.append((key, start, head, min(quiet, head)))
            if tokens > head:
                items.insert(0, (key, start + head, tokens - head, max(0, quiet - head)))
            want -= head
        yield inside


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, max_segments: int = 256, max_loss: int | None = None, end_id: int = 0,
         prompt: str | None = None, cut: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``prompt`` names a column with the number of leading tokens that bear no loss. Without ``cut`` examples stay whole, and
    one that exceeds a limit is an error. A sequence's tokens, segments and loss-bearing tokens stay within the limits."""
    bounded_batches(docs.sparkSession)
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from vecspark.llm.tokens import shared_tokenizer

        encoder, end = shared_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        packer, bodies, held = Packer(limits, cut), {}, 0
        docs_seen = 0

        def written(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for items in sequences:
                at = 0
                for key, start, n, quiet in items:
                    doc, ids = bodies[key]
                    rows.append((doc, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, number, at, n - quiet))
                    at += n
                number += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in PIECE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECE.split(", ")])

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal packer, bodies, held
            done, rest = list(whole), []
            whole.clear()
            for items, full in packer.sequences():
                if full or sum(x[2] for x in items) == max_tokens:
                    done += at_powers(items) if cut and sum(x[2] for x in items) < max_tokens else [items]
                elif last:
                    done += at_powers(items) if cut else [items]
                else:
                    rest += items
            out = written(done)
            bodies, packer = {x[0]: bodies[x[0]] for x in rest}, Packer(limits, cut)
            for x in rest:
                packer.add(*x)
            held = sum(len(ids) // 4 for _, ids in bodies.values())
            return out

        whole: list[list[tuple]] = []
        for batch in small_batches(batches, "text"):
            prompts = batch.column("quiet").to_pylist()
            for doc, text, quiet in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), prompts, strict=True):
                ids = encoder.encode(text) + end
                start, tokens, key = 0, len(ids) // 4, docs_seen
                quiet = min(max(quiet or 0, 0), tokens)
                docs_seen += 1
                bodies[key] = (doc, ids)
                while cut and tokens >= max_tokens and max_tokens - min(quiet, max_tokens) <= limits[2]:
                    whole.append([(key, start, max_tokens, min(quiet, max_tokens))])
                    start, tokens, quiet = start + max_tokens, tokens - max_tokens, max(0, quiet - max_tokens)
                if tokens:
                    packer.add(key, start, tokens, quiet)
                held += len(ids) // 4
                if held >= block_tokens:
                    yield packed(last=False)
        yield packed(last=True)

    quiet = F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")
    return docs.select("doc_id", text_of().alias("text"), quiet.alias("quiet")).mapInArrow(pieces, PIECE)
