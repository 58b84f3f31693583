"""Fill-in-the-middle transformation over a Fenwick tree of fixed text blocks.

A text is UTF-8 and consists of units: its lines, each with its newline, the
last one possibly without.

1. The text is cut into blocks of ``BLOCK`` bytes.  Two Fenwick trees over the
   blocks hold the number of units that end in a block and of code points that
   begin in it.
2. Two unit numbers drawn from the document's hash are the cuts.  Binary lifting
   descends the unit tree to the block in which a cut falls, adding up the code
   points on the way, in a logarithmic number of steps; inside that block alone
   the boundary is located by looking at its bytes.
3. The middle between the cuts goes to the end: ``<P>`` prefix ``<S>`` suffix
   ``<M>`` middle (psm), or suffix first (spm).  Texts that hold a sentinel, empty
   texts and the hash's share of others stay as they are (plain).

``restored`` rebuilds the text from output and form alone.

Defined results: null counts as the empty text, which is plain with no units; a
null doc_id hashes as no digits; repeated rows get equal results; extra columns
play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import ship

SEED = 7
FIM_PERCENT = 100      # share of texts that are transformed
SPM_PERCENT = 50       # share of those that put the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 4096


class BlockTree:
    """Fenwick trees over the blocks of a text: units that end in a block, code points that begin in it."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        self.size = len(text)
        self.bytes = np.frombuffer(text, np.uint8)
        starts = np.arange(0, self.size, block)
        ends = self.bytes == 10
        self.newlines = ends
        self.first = (self.bytes & 0xC0) != 0x80      # a byte that begins a code point
        per_block = [np.add.reduceat(x, starts, dtype=np.int64) if self.size else np.zeros(0, np.int64)
                     for x in (ends, self.first)]
        if self.size and not ends[-1]:
            per_block[0][-1] += 1                      # the last line ends with the text
        self.units, self.chars = (self._tree(x) for x in per_block)
        self.total_units = int(per_block[0].sum())
        self.total_chars = int(per_block[1].sum())

    @staticmethod
    def _tree(counts: np.ndarray) -> np.ndarray:
        """Node i (from 1) holds the sum of the ``i & -i`` blocks up to block i."""
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(len(sums))
        return sums - sums[at - (at & -at)]

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        if k >= self.total_units:
            return self.size, self.total_chars
        blocks = len(self.units) - 1
        at, left, chars = 0, k, 0
        step = 1 << (blocks.bit_length() - 1)
        while step:
            to = at + step
            if to <= blocks and self.units[to] < left:  # the k-th unit ends beyond these blocks
                at, left, chars = to, left - int(self.units[to]), chars + int(self.chars[to])
            step >>= 1
        start = at * self.block
        inside = int(np.flatnonzero(self.newlines[start:start + self.block])[left - 1]) + 1
        return start + inside, chars + int(self.first[start:start + inside].sum())


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: bytes, doc_id, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix code points, middle code points, output) of one text."""
    tree = BlockTree(text, block)
    n = tree.total_units
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or p in text or s in text or m in text or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    (a, a_chars), (z, z_chars) = (tree.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < spm_percent:
        return n, "spm", a_chars, z_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a_chars, z_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for a in range(0, b.num_rows, 256):        # outputs are as long as the texts: few at a time
                ids = b.column(0).slice(a, 256)
                rows = [transform(t.as_py() or b"", d, seed, fim_percent, spm_percent, block)
                        for d, t in zip(ids.to_pylist(), texts.slice(a, 256))]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made from."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    # a transformed text holds each sentinel once, the first one at its head
    part = F.split(out, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    return (F.when(kind == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
            .when(kind == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
            .otherwise(out))


def digests(transformed: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with digests of the output and of the rebuilt text instead of the output."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"))
