"""Filling fixed-capacity containers: hierarchical residual packing.

Items are mixed by hash first, so that kinds stored apart meet. Every partition packs its items by best fit, largest first,
and emits the nearly full bins. The bins left underfull go up a tree as items of their own: several partitions' rests meet
in one node, are packed again by best fit, and so on to the root. No item is ever split unless it alone exceeds the capacity.

How many bins a node hands up is bounded without losing a merge. After best fit no two bins of a node fit together, so at
most one of them is half empty. Two bins merge only if one of them is half empty: over the whole tree there are at most as
many merges as leaves, and each of the half-empty bins needs one partner, which the emptiest bins give at best. A node that
hands up as many of its emptiest bins as there are leaves therefore allows the same number of merges as one that hands up all.
"""

from __future__ import annotations

import base64
import importlib.util
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.session import shuffle_partitions

CAPACITY = 2_048
#: A bin is nearly full from this share of the capacity on.
FULL = 0.98
#: Items packed at a time within a partition, and children of a tree node.
BATCH, FAN_IN = 20_000, 8
#: Underfull bins that a node hands up at least; it is as many as there are leaves where those are more (see above). Batches
#: of one leaf hand on as many: in mixed batches of 20,000 a kind exceeds what fits it by chance by some hundred at most.
HAND_UP = 512
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PIECES = "doc_id string, piece_no int, n_pieces int, char_start int, char_end int, n_tokens int"
_BINS = f"level int, node int, bin int, load int, closed boolean, members array<struct<{', '.join(x.replace(' ', ':') for x in _PIECES.split(', ')).replace(', ', ',')}>>"


def vocabulary(path: str) -> tuple[str, bytes]:
    """(splitting pattern, ranks) of a rank file; the pattern lies beside it. Read by the driver alone."""
    where = Path(path).resolve().parent / "__init__.py"
    spec = importlib.util.spec_from_file_location("vocabulary_files", where)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN, Path(path).read_bytes()


@cache
def byte_bpe(pattern: str, ranks: bytes) -> Callable:
    """The tokenizer of a vocabulary, made once per worker."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def cut_tokens(encoding, tokens: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(first character, last character + 1, tokens) of pieces of an oversized text, cut between characters."""
    pieces, at, char = [], 0, 0
    while at < len(tokens):
        end = min(len(tokens), at + capacity)
        # a token may end within a character; step back to a token that does not
        while end < len(tokens) and end > at + 1 and (encoding.decode_single_token_bytes(tokens[end])[0] & 0xC0) == 0x80:
            end -= 1
        data = encoding.decode_bytes(tokens[at:end])
        n = sum((b & 0xC0) != 0x80 for b in data)
        pieces.append((char, char + n, end - at))
        at, char = end, char + n
    return pieces


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions by bin, best fit decreasing; ties by position, so the result is the same on every run."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(rooms, (sizes[i], -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], b))
        elif sizes[i] == 0:
            insort(rooms, (room, b))
    return bins


def measure(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Items: one row per text, or per piece of a text over the capacity. NULL and empty texts are items of 0 tokens.

    The vocabulary, of a fixed size (some MB), is sent to the executors, which need no copy of it on their disks.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = byte_bpe(*shipped.value)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                text = text or ""
                got = encoding.encode_ordinary(text)
                pieces = [(0, len(text), len(got))] if len(got) <= capacity else cut_tokens(encoding, got, capacity)
                rows += [(doc, k, len(pieces), a, b, n) for k, (a, b, n) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"doc_id": object})

    # ids travel as text: a batch with a NULL id would turn the others into floating point
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tokens, _PIECES)


def _close(level: int, node: int, packed: list[tuple[int, list]], capacity: int, hand_up: int) -> pd.DataFrame:
    """Bins as rows; at most ``hand_up`` of the emptiest stay open."""
    full = FULL * capacity
    open_bins = sorted((load, k) for k, (load, _) in enumerate(packed) if load < full)[:hand_up]
    handed = {k for _, k in open_bins}
    rows = [(level, node, k, load, k not in handed, members) for k, (load, members) in enumerate(packed)]
    return pd.DataFrame(rows, columns=["level", "node", "bin", "load", "closed", "members"])


def pack(documents: DataFrame, stage: Callable[[DataFrame, str], DataFrame], capacity: int = CAPACITY, tokenizer: str = TOKENIZER, fan_in: int = FAN_IN, least_handed: int | None = None) -> DataFrame:
    """Every document placed exactly once: doc_id, piece_no, n_pieces, char_start, char_end, n_tokens, container, load.

    documents: doc_id, text; repeated rows are placed each; a NULL id is kept. No container holds more than ``capacity``
    tokens; only a text above it is cut. ``stage`` writes a table to the shared folder and reads it back: each level is
    written once, so a lost executor repeats one node at most. A node receives at most ``fan_in`` times the greater of
    ``least_handed`` (``HAND_UP``) and the number of leaves, whatever the number of items.
    """
    leaves = shuffle_partitions(documents.sparkSession)
    hand_up = max(HAND_UP if least_handed is None else least_handed, leaves)
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node, offset, rest = TaskContext.get().partitionId(), 0, []
        held: list[tuple[int, dict]] = []

        def emit(items: list[tuple[int, list]], last: bool) -> pd.DataFrame:
            nonlocal offset, rest
            bins = [(sum(items[i][0] for i in b), [m for i in b for m in items[i][1]]) for b in best_fit([n for n, _ in items], capacity)]
            if not last:  # the underfull ones go into the next batch
                rest = [b for b in bins if b[0] < FULL * capacity]
                rest, done = sorted(rest, key=lambda b: b[0])[:hand_up], [b for b in bins if b[0] >= FULL * capacity] + sorted(rest, key=lambda b: b[0])[hand_up:]
                out = pd.DataFrame([(0, node, offset + k, load, True, m) for k, (load, m) in enumerate(done)], columns=["level", "node", "bin", "load", "closed", "members"])
                offset += len(done)
                return out
            out = _close(0, node, bins, capacity, hand_up)
            out["bin"] += offset
            return out

        for pdf in batches:
            for row in zip(*(pdf[c].tolist() for c in names)):
                held.append((row[-1], [dict(zip(names, row))]))
            if len(held) >= BATCH:
                yield emit(rest + held, False)
                held = []
        if held or rest:
            yield emit(rest + held, True)

    def node_of(level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["node", "bin"], kind="stable")
            loads, members = pdf["load"].tolist(), pdf["members"].tolist()
            packed = [(sum(loads[i] for i in b), [dict(m) for i in b for m in members[i]]) for b in best_fit(loads, capacity)]
            return _close(level, int(key[0]), packed, capacity, 0 if last else hand_up)

        return merge

    items = measure(documents, capacity, tokenizer)
    # the row number spreads repeated rows, too; sorting mixes the batches within a partition
    mixed = items.withColumn("h", F.xxhash64("doc_id", "piece_no", "n_tokens", F.monotonically_increasing_id()))
    mixed = mixed.repartition(leaves, "h").sortWithinPartitions("h").drop("h")
    bins = stage(mixed.mapInPandas(leaf, _BINS), "packing-0")
    levels, level = [bins.where("closed")], 0
    open_bins = bins.where("not closed")
    nodes = bins.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] + 1
    while True:
        level, nodes = level + 1, -(-nodes // fan_in)
        merged = open_bins.withColumn("parent", F.expr(f"cast(node div {fan_in} as int)")).groupBy("parent").applyInPandas(node_of(level, nodes == 1), _BINS)
        if nodes == 1:
            levels.append(merged)
            break
        bins = stage(merged, f"packing-{level}")
        levels.append(bins.where("closed"))
        open_bins = bins.where("not closed")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(F.format_string("%d-%d-%d", "level", "node", "bin").alias("container"), "load", F.explode("members").alias("m")).select(F.col("m.doc_id").cast("long").alias("doc_id"), *(f"m.{c}" for c in names[1:]), "container", "load")
