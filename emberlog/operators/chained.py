"""Order-dependent scans (greedy merging, tracking, matching) that still run in parallel.

Each such operator looks back a bounded distance along an axis.  The axis is cut into *pieces* no shorter than the
look-back; a crowded key gets shorter pieces than a sparse one.  The live state at the end of a piece is the starting
state of the next, unless a gap longer than the look-back lies between them.  The first pass lays neighbouring pieces
into the same task, which hands the state on as it goes; only the first piece of a task starts empty.  Pieces whose true
starting state has other content are scanned again until nothing changes; that concerns no more keys than there are tasks.

Ids are no part of that content.  A live entry that came in with the starting state is known by its slot there, and a
row that joins it is given the slot; only afterwards are slots followed from piece to piece to the row that opened the
entry, doubling the distance in each round.  An entry that lives through a whole session so costs a few scans and a
logarithm of rounds over tables of a few rows per piece.  The result equals one sequential pass, and no task ever holds
more than the stream of one piece plus its live state.

The rows are shuffled once and written once, with what the first pass found; only the rows of keys that were cut between
two tasks are written or shuffled again.

A NULL key is a key like any other.  A row without an axis value has no place in the order: it is kept, with
``assigned`` NULL, and influences nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberlog.session import cut_lineage

# A rule receives the live list and one row (a tuple of ``fields`` in order) and returns the
# id assigned to the row, or None.  Live entries are lists: [id, last_axis, *numbers].  A rule that looks at the
# ids of its entries says so by a true attribute ``reads_ids``; then ids are part of the content handed over.
Rule = Callable[[list, tuple], "int | None"]

PIECE, EDGE, ASSIGNED, STATE, SLOT, REF, TAKEN = "_piece", "_edge", "assigned", "_state", "_slot", "_ref", "_taken"
# What a scan adds to its rows; ``_state`` as JSON, since a nested column would slow every row.
FOUND = {ASSIGNED: pa.int64(), STATE: pa.string(), SLOT: pa.int32(), REF: pa.int32(), TAKEN: pa.bool_()}
NOWHERE = -(1 << 62)  # the piece of rows without an axis value
HASHES = 1 << 14  # key counts are first taken by hash; 250,000 rows for each of them are 4 thousand million


class _Inherited(int):
    """The slot of an entry in the starting state of a piece, in place of the id; ``origin`` is the id as far as the
    task knows it, which is right where its run was not cut between two tasks."""

    origin: int | None = None

    @classmethod
    def at(cls, slot: int, owner: int) -> _Inherited:
        out = cls(slot)
        out.origin = owner.origin if type(owner) is _Inherited else owner
        return out


def _never_null(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Stand-ins for the keys that never are NULL, so that joins treat all sessions alike whatever their length."""
    kinds = dict(df.dtypes)
    for i, key in enumerate(keys):
        blank = F.lit("" if kinds[key] == "string" else 0).cast(kinds[key])
        df = df.withColumns({f"_key{i}": F.coalesce(F.col(key), blank), f"_none{i}": F.col(key).isNull()})
    return df, [f"{n}{i}" for i in range(len(keys)) for n in ("_key", "_none")]


def _piece_spans(df: DataFrame, keys: list[str], axis: str, window: int, span: int, rows_per_piece: int) -> tuple[DataFrame | None, bool]:
    """(``_span`` of each crowded key, None without such keys; whether every key fits one piece).

    A key gets pieces of about ``rows_per_piece`` rows or of ``span`` axis units, whichever is less, but never
    shorter than the look-back.  Only keys of more than ``rows_per_piece`` rows can need the former, so keys are counted one by one
    only where a hash of theirs has so many rows.  The extent and those hashes reach the driver.
    """
    placed = df.filter(F.col(axis).isNotNull())
    hashed = F.pmod(F.hash(*keys), F.lit(HASHES))
    counts = placed.groupBy(hashed.alias("_h")).agg(F.min(axis).alias("_min"), F.max(axis).alias("_max"), F.count("*").alias("_n"))
    many = F.collect_list(F.when(F.col("_n") > rows_per_piece, F.col("_h")))
    least, most, full = counts.agg(F.min("_min"), F.max("_max"), many).first()
    fits = least is None or most - least + 1 <= max(window + 1, span)
    if not full:
        return None, fits
    extent = placed.filter(hashed.isin(full)).groupBy(*keys).agg((F.max(axis) - F.min(axis) + 1).cast("bigint").alias("_width"), F.count("*").alias("_n"))
    fit = F.floor(F.col("_width") * rows_per_piece / F.col("_n"))
    own = F.greatest(F.lit(window + 1), F.least(F.lit(span), fit)).cast("bigint")
    spans = cut_lineage(extent.filter(F.col("_n") > rows_per_piece).select(*keys, own.alias("_span"), "_width"))
    return spans.drop("_width"), fits and not spans.agg(F.max(F.col("_width") > F.col("_span"))).first()[0]


def _values(column: pa.Array) -> list:
    """Python values of a column; numeric columns without NULLs take the fast way."""
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _unscanned(batch: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
    """Adds the columns of ``FOUND`` to rows that no scan has seen."""
    n = batch.num_rows
    added = {ASSIGNED: FOUND[ASSIGNED]} if whole else FOUND
    arrays = [pa.array([-1] * n, kind) if name == SLOT else pa.nulls(n, kind) for name, kind in added.items()]
    fields = [*batch.schema, *[pa.field(name, kind) for name, kind in added.items()]]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema(fields))


def _scanner(keys: list[str], axis: str, fields: list[str], window: int, rule: Rule, whole: bool, first: bool):
    """Builds the ``mapInArrow`` body: one pass over rows sorted by piece and order.

    Columns the rule does not need stay Arrow data and pass through untouched.  In the ``first`` pass, a piece right after
    the one before starts with its closing state, and that state is marked as ``_taken``.  As neighbours lie together there, a
    state that is not taken has no successor, unless it is the last of its task.
    """
    reads_ids = getattr(rule, "reads_ids", False)
    piece = keys if whole else [*keys, PIECE]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live, edge, last_axis, layout = None, [], None, None, None

        def closing() -> list[tuple]:
            # Only a piece that reaches its end edge can hand anything over.
            if whole or current is None or last_axis is None or last_axis + window < edge:
                return []
            return [(current, slot, entry) for slot, entry in enumerate(live) if entry[1] + window >= edge]

        for batch in batches:
            batch = _unscanned(batch, whole) if first else batch
            layout = batch.schema
            groups = list(zip(*(_values(batch[c]) for c in piece)))
            rows = list(zip(*(_values(batch[c]) for c in fields)))
            axes, slots = _values(batch[axis]), None if first else _values(batch[SLOT])
            edges = None if whole else _values(batch[EDGE])
            resumed = not first and max(slots, default=-1) >= 0
            states, owners = (batch[STATE].to_pylist(), _values(batch[ASSIGNED])) if resumed else (None, None)
            found, keep, carries = [], [], []
            for i, group in enumerate(groups):
                if group != current:
                    ends = closing()
                    taken = first and bool(ends) and group == (*current[:-1], current[-1] + 1)
                    carries.extend((*end, taken) for end in ends if taken or not first)
                    live = [[entry[0] if reads_ids else _Inherited.at(slot, entry[0]), *entry[1:]] for _, slot, entry in ends] if taken else []
                    current, last_axis = group, None
                if resumed and slots[i] >= 0:
                    live.append([owners[i] if reads_ids else _Inherited(slots[i]), *json.loads(states[i])])
                    continue
                keep.append(i)
                now = axes[i]
                if now is None:
                    found.append(None)
                    continue
                if now != last_axis:
                    live[:] = [e for e in live if now - e[1] <= window]
                    last_axis = now
                    edge = None if whole else edges[i]
                found.append(rule(live, rows[i]))
            out = batch.take(pa.array(keep, pa.int64())) if resumed else batch
            if whole:
                ids, refs = found, None
            else:
                ids = [x.origin if type(x) is _Inherited else x for x in found]
                refs = [int(x) if type(x) is _Inherited else None for x in found]
            out = out.set_column(layout.get_field_index(ASSIGNED), layout.field(ASSIGNED), pa.array(ids, pa.int64()))
            yield out if whole else out.set_column(layout.get_field_index(REF), layout.field(REF), pa.array(refs, pa.int32()))
            if carries:
                yield _carry_batch(carries, keys, layout)
        tail = closing()
        if tail:
            yield _carry_batch([(*end, False) for end in tail], keys, layout)

    return scan


def _carry_batch(carries: list[tuple], keys: list[str], layout: pa.Schema) -> pa.RecordBatch:
    data = {f.name: [None] * len(carries) for f in layout}
    for n, (group, slot, entry, taken) in enumerate(carries):
        for c, v in zip([*keys, PIECE], group):
            data[c][n] = v
        data[SLOT][n], data[TAKEN][n] = slot, taken
        if type(entry[0]) is _Inherited:
            data[REF][n], data[ASSIGNED][n] = int(entry[0]), entry[0].origin
        else:
            data[ASSIGNED][n] = int(entry[0])
        data[STATE][n] = json.dumps(entry[1:])
    return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) for f in layout], schema=layout)


def _opened_by(states: DataFrame, piece: list[str]) -> DataFrame:
    """``(piece, _slot, _id)``: the row that opened each entry of the starting states.

    An entry that its piece inherited as well points to a slot of the piece before.  Each round replaces a pointer by the
    pointer it leads to, so the distance doubles.
    """
    *run, at = piece
    up_at, up_slot = "_up_piece", "_up_slot"
    own = F.col(REF).isNull()
    nodes = states.select(*piece, SLOT, F.when(own, F.col(ASSIGNED)).alias("_id"), F.when(~own, F.col(at) - 1).alias(up_at), F.col(REF).alias(up_slot))
    nodes = cut_lineage(nodes)
    while not nodes.filter(F.col("_id").isNull()).isEmpty():
        over = nodes.select(*run, F.col(at).alias(up_at), F.col(SLOT).alias(up_slot), F.col("_id").alias("_their_id"), F.col(up_at).alias("_their_piece"), F.col(up_slot).alias("_their_slot"))
        moved = nodes.filter(F.col("_id").isNull()).join(over, [*run, up_at, up_slot])
        moved = moved.select(*piece, SLOT, F.col("_their_id").alias("_id"), F.col("_their_piece").alias(up_at), F.col("_their_slot").alias(up_slot))
        nodes = cut_lineage(nodes.filter(F.col("_id").isNotNull()).unionByName(moved))
    return nodes.select(*piece, SLOT, "_id")


def chained_scan(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    order: Sequence[str],
    fields: Sequence[str],
    window: int,
    rule: Rule,
    span: int = 16384,
    rows_per_piece: int = 250_000,
) -> DataFrame:
    """Adds ``assigned`` (bigint) to every row of ``df``: the id chosen by ``rule``.

    ``order`` must make the row order inside a key total.  ``fields`` are the columns the
    rule sees; ``axis`` must be an integer column.
    """
    fields, base, own_keys = list(fields), df.columns, list(keys)
    df, keys = _never_null(df, own_keys)
    # Keys that span less than one piece need no exchange: the key is the piece.
    spans, whole = _piece_spans(df, keys, axis, window, span, rows_per_piece)
    piece = keys if whole else [*keys, PIECE]
    # The stand-ins tell the keys, so the rows do without them on the way.
    data = [c for c in df.columns if c not in own_keys or c in (axis, *order, *fields)]
    again = {c: F.when(~F.col(f"_none{i}"), F.col(f"_key{i}")).alias(c) for i, c in enumerate(own_keys) if c not in data}
    result = [again.get(c, F.col(c)) for c in base]
    # A fixed count: pieces of Python work should not be merged because their bytes are few.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(laid: DataFrame, first: bool) -> DataFrame:
        """One pass; columns that can be told from others are made after the shuffle."""
        # ``axis`` is NULL on carried state, so it sorts before the rows of its piece.
        ordered = laid.sortWithinPartitions(*piece, F.col(axis).asc_nulls_first(), *([] if first else [SLOT]), *order)
        kinds = [(f.name, f.dataType) for f in laid.schema.fields]
        if first:
            kinds += [(ASSIGNED, T.LongType())] if whole else [(ASSIGNED, T.LongType()), (STATE, T.StringType()), (SLOT, T.IntegerType()), (REF, T.IntegerType()), (TAKEN, T.BooleanType())]
        schema = T.StructType([T.StructField(name, kind, True) for name, kind in kinds])
        return ordered.mapInArrow(_scanner(keys, axis, fields, window, rule, whole, first), schema)

    if whole:
        return run(df.select(*data).repartition(parts, *keys), first=True).select(*result, ASSIGNED)

    if spans is None:
        length = F.lit(max(window + 1, span)).cast("bigint")
    else:  # no more of them than there are times ``rows_per_piece`` rows
        df, data = df.join(F.broadcast(spans), keys, "left"), [*data, "_span"]
        length = F.coalesce("_span", F.lit(max(window + 1, span)))
    at = F.coalesce(F.floor(F.col(axis) / length).cast("bigint"), F.lit(NOWHERE))

    def edged(rows: DataFrame) -> DataFrame:
        return rows.withColumn(EDGE, F.when(F.col(PIECE) > NOWHERE, (F.col(PIECE) + 1) * length))

    placed = edged(df.select(*data).repartitionByRange(parts, *keys, at).withColumn(PIECE, at))
    scans = [cut_lineage(run(placed, first=True).drop(EDGE))]
    columns = scans[0].columns
    rows, ends = scans[0].filter(F.col(SLOT) < 0), scans[0].filter(F.col(SLOT) >= 0).withColumn(PIECE, F.col(PIECE) + 1)
    # First pieces of tasks that should not have started empty; few, as there is one for each task at most.
    last_of_tasks = ends.filter(~F.col(TAKEN)).select(*piece).distinct()
    changed = cut_lineage(rows.select(*piece).join(F.broadcast(last_of_tasks), piece, "left_semi").distinct())
    if changed.isEmpty():
        return rows.select(*result, ASSIGNED)

    # No change leaves its key, so the rounds read the keys that were cut between two tasks; in all others ids are known.
    cut = F.broadcast(changed.select(*keys).distinct())
    inside = rows.join(cut, keys, "left_semi").select(*columns)
    later = cut_lineage(inside.withColumns({c: F.lit(None).cast(k) for c, k in ((ASSIGNED, "bigint"), (REF, "int"), (TAKEN, "boolean"))}))
    known = ends.join(cut, keys, "left_semi").join(F.broadcast(changed.withColumn("_first", F.lit(True))), piece, "left")
    states = cut_lineage(known.filter(F.col(TAKEN) | F.col("_first")).select(*columns))  # a few rows per piece

    def handed_over(scanned: DataFrame) -> DataFrame:
        """Closing states of pieces scanned again, addressed to the piece that starts with them."""
        ends = scanned.filter(F.col(SLOT) >= 0).withColumn(PIECE, F.col(PIECE) + 1)
        there = later.select(*piece).join(F.broadcast(ends.select(*piece).distinct()), piece, "left_semi").distinct()
        return ends.join(F.broadcast(there), piece, "left_semi").select(*columns)

    def content(states: DataFrame) -> DataFrame:
        seen = [ASSIGNED, SLOT, STATE] if getattr(rule, "reads_ids", False) else [SLOT, STATE]
        return states.groupBy(*piece).agg(F.sum(F.xxhash64(*seen).cast("decimal(38,0)")).alias("_print"))

    redone: list[DataFrame] = []
    # Each round settles at least one more piece of every key, so this ends.  Only the pieces
    # whose starting state changed are scanned and written again.
    while not changed.isEmpty():
        few = F.broadcast(changed)
        anew = later.join(few, piece, "left_semi").unionByName(states.join(few, piece, "left_semi")).select(*columns)
        fresh = cut_lineage(run(edged(anew.repartition(parts, *piece)), first=False).drop(EDGE))
        redone.append(changed.withColumn("_last", F.lit(len(scans))))
        scans.append(fresh)
        # A piece scanned again hands its new closing state to its successor.
        successors = changed.withColumn(PIECE, F.col(PIECE) + 1)
        updated = cut_lineage(states.join(F.broadcast(successors), piece, "left_anti").unionByName(handed_over(fresh)))
        old = content(states).withColumnRenamed("_print", "_old")
        differing = content(updated).join(old, piece, "full").filter(~F.col("_print").eqNullSafe(F.col("_old")))
        changed, states = cut_lineage(differing.select(*piece)), updated

    # Of every piece, the rows of its last scan.
    rounds = [inside, *[scan.filter(F.col(SLOT) < 0).select(*columns) for scan in scans[1:]]]
    scanned = reduce(DataFrame.unionByName, [scan.withColumn("_round", F.lit(n)) for n, scan in enumerate(rounds)])
    last = reduce(DataFrame.unionByName, redone).groupBy(*piece).agg(F.max("_last").alias("_last"))
    scanned = scanned.join(last, piece, "left").filter(F.col("_round") == F.coalesce("_last", F.lit(0)))
    opened = _opened_by(states, piece).withColumnRenamed(SLOT, REF)
    found = scanned.join(opened, [*piece, REF], "left").select(*result, F.coalesce("_id", ASSIGNED).alias(ASSIGNED))
    return rows.join(cut, keys, "left_anti").select(*result, ASSIGNED).unionByName(found)
