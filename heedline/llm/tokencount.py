"""Edit-aware token counts (operator 9).

A document keeps a segment tree over its pre-token units (the stretches between single spaces,
across which the byte-level pattern never joins).  A leaf stands for LEAF_UNITS units and has
their code points and tokens; inner nodes have the sums.  An edit finds its leaves by descending
on code points, re-encodes these leaves and one leaf on either side (the units at the edges
may join or part there, further ones can't), and updates the sums on the paths above.

An edit (at, remove, insert) removes ``remove`` code points at ``at`` and puts ``insert`` there;
places are cut to the text as it is then, negative and null numbers count as 0, a null insert
as empty.  Edits of a document apply in their order; null and no edits leave it.  A null text
counts as empty.  Every row gives one row, equal ids or none; extra columns are ignored; an empty table gives
an empty result.  A very long text is held whole with its tree, by one task.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heedline.llm.common import small_batches
from heedline.llm.packing import token_ids, unit_splitter

LEAF_UNITS = 16
EDITS = "array<struct<at: long, remove: long, insert: string>>"


class CountTree:
    """Row 0 of ``nodes`` has code points, row 1 tokens; node 1 is the root, leaves are the last half."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        self.first_leaf = nodes.shape[1] // 2

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> "CountTree":
        size = 1 << max(0, len(chars) - 1).bit_length()
        nodes = np.zeros((2, 2 * size), np.int64)
        nodes[0, size : size + len(chars)], nodes[1, size : size + len(chars)] = chars, tokens
        tree = cls(nodes)
        while size > 1:
            size //= 2
            nodes[:, size : 2 * size] = nodes[:, 2 * size : 4 * size : 2] + nodes[:, 2 * size + 1 : 4 * size : 2]
        return tree

    @property
    def chars(self) -> int:
        return int(self.nodes[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` (the last one from the end on) and its start."""
        node, start = 1, 0
        while node < self.first_leaf:
            node *= 2
            if at >= start + self.nodes[0, node] and self.nodes[0, node + 1]:
                start += int(self.nodes[0, node])
                node += 1
        return node - self.first_leaf, start

    def put(self, first: int, values: np.ndarray) -> None:
        """New values of the leaves from ``first`` on, and the sums above them."""
        lo, hi = self.first_leaf + first, self.first_leaf + first + values.shape[1] - 1
        self.nodes[:, lo : hi + 1] = values
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            self.nodes[:, lo : hi + 1] = self.nodes[:, 2 * lo : 2 * hi + 2 : 2] + self.nodes[:, 2 * lo + 1 : 2 * hi + 2 : 2]


class Counter:
    def __init__(self, tokenizer_path: str):
        self.encode, self.units = token_ids(tokenizer_path), unit_splitter()

    def leaves(self, text: str, leaf_units: int) -> np.ndarray:
        units = self.units(text)
        parts = [units[i : i + leaf_units] for i in range(0, len(units), leaf_units)]
        # A leaf but the first begins with a space, which belongs to its first unit.
        chars = [sum(map(len, p)) + len(p) for p in parts]
        chars[0] -= 1
        tokens = self.encode([parts[0], *[[None, *p] for p in parts[1:]]])
        return np.array([chars, [len(t) // 4 for t in tokens]])

    def tree(self, text: str) -> CountTree:
        return CountTree.of(*self.leaves(text, LEAF_UNITS))

    def edit(self, text: str, tree: CountTree, at: int, remove: int, insert: str) -> tuple[str, int]:
        """The new text, and how many code points were encoded again; ``tree`` is updated."""
        at = min(max(at, 0), len(text))
        remove = min(max(remove, 0), len(text) - at)
        first, start = tree.find(at)
        last = tree.find(at + max(remove - 1, 0))[0]
        # One leaf of context on either side; leaves that edits have emptied don't count.
        if start:
            first, start = tree.find(start - 1)
        end = start + int(tree.nodes[0, tree.first_leaf + first : tree.first_leaf + last + 1].sum())
        if end < len(text):
            last = tree.find(end)[0]
            end += int(tree.nodes[0, tree.first_leaf + last])
        old = text[start:end]
        new = old[: at - start] + insert + old[at - start + remove :]
        width = last - first + 1
        n_units = len(self.units(new)) if new else 0
        values = np.zeros((2, width), np.int64)
        if n_units:
            got = self.leaves(new, -(-n_units // width))
            values[:, : got.shape[1]] = got
        tree.put(first, values)
        return text[:start] + new + text[end:], len(new)


def with_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text, tree, n_tokens) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in small_batches(batches):
            trees = [counter.tree(t) for t in batch.column("text").to_pylist()]
            nodes = pa.array([t.nodes.tobytes() for t in trees], pa.binary())
            counts = pa.array([t.tokens for t in trees], pa.int64())
            names = [*batch.schema.names, "tree", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes, counts], names)

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, text string, tree binary, n_tokens long")


def apply_edits(counted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Applies ``edits`` to (doc_id, text, edits): the new text, tree and count, and what the edits cost.

    A stored ``tree`` is taken up where there is one; without one the text is counted first.
    """
    stored = "tree" in counted.columns
    text = F.coalesce("text", F.lit("")).alias("text")
    counted = counted.select("doc_id", text, "edits", *["tree"] * stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in small_batches(batches):
            out = [[] for _ in range(5)]
            texts, all_edits = (batch.column(c).to_pylist() for c in ("text", "edits"))
            trees = batch.column("tree").to_pylist() if stored else [None] * len(texts)
            for text, nodes, edits in zip(texts, trees, all_edits):
                tree = counter.tree(text) if nodes is None else CountTree(np.frombuffer(nodes, np.int64).reshape(2, -1).copy())
                before, encoded = tree.tokens, 0
                for e in edits or []:
                    if e is not None:
                        text, n = counter.edit(text, tree, e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                        encoded += n
                for column, value in zip(out, (text, tree.nodes.tobytes(), before, tree.tokens, encoded)):
                    column.append(value)
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            names = ["doc_id", "text", "tree", "n_tokens_before", "n_tokens", "encoded_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    kinds = "doc_id long, text string, tree binary, n_tokens_before long, n_tokens long, encoded_chars long"
    return counted.mapInArrow(run, kinds)


def edited_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Counts of every document before and after three edits that are made from its own text.

    A sentence put in at a third, a passage taken out at two thirds, and a new end.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    third = F.floor(n / 3).cast("long")

    def edit(at, remove, insert):
        return F.struct(at.alias("at"), remove.cast("long").alias("remove"), insert.alias("insert"))

    edits = F.array(
        edit(third, F.lit(0), F.concat(F.lit(" Inserted here: "), F.substring("text", 1, 60))),
        edit(2 * third, F.floor(n / 20), F.lit("")),
        edit(n.cast("long"), F.lit(0), F.concat(F.lit("\n"), F.substring("text", 1, 80))),
    )
    done = apply_edits(docs.select("doc_id", "text", edits.alias("edits")), tokenizer_path)
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "n_tokens_before",
        "n_tokens",
        "encoded_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
