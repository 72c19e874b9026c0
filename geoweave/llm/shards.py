"""Balanced label propagation: linked documents are moved to their neighbours' shards.

Documents are linked where they are members of one group, by default of equal texts; a
document may be in any number of groups. A group stands for the links between all its
members, which are never written out: what a member has to know of its neighbours is how many
of them each shard holds, one short array for each group.

Every round counts these arrays, lets each linked document wish for the shard that holds most
of its neighbours (itself among them, so that all members of a group wish alike and don't
change places for ever), and grants wishes by quotas for each pair of shards: exchanges of
equal numbers, and what room the target has. Wishes with the greatest gain go first. Only
shards with room can be wished for, or the rest of a group that is larger than a shard would
wait for the full one; where that gains nothing more, a round in which all shards can be wished
for finds exchanges. Documents without links are dealt last and fill every shard up to its
exact share, so that the numbers of rows differ by one at most.

All steps are joins, aggregations and windows on narrow rows; texts are read once. Ranks are
taken in cells of hashed rows and completed by the sums of the cells before, so no task ranks
all rows of a shard. The driver sees counts by pairs of shards only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import discard, picked, stored

SHARDS = 16
#: At most so many rounds; propagation ends earlier, when a round of each kind doesn't lower the cut.
ROUNDS = 24
#: Rows of a cell in which ranks are taken.
CELL_ROWS = 1 << 16


def _cells(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // CELL_ROWS + 1)


def _counted(rows: DataFrame, by: list[str], order: list[Column], cells: int, name: str) -> DataFrame:
    """``rows`` with their gapless number from 0 within ``by``, in the order of ``order`` (columns of few values) and then of hashed cells."""
    keys = [F.col(c) for c in by]
    ranks = [f"_order{i}" for i in range(len(order))]
    placed = rows.withColumns(dict(zip(ranks, order)) | {"_cell": F.pmod(F.xxhash64("node"), F.lit(cells)).cast("int")})
    sums = placed.groupBy(*by, *ranks, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*ranks, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, *ranks, "_cell").orderBy("node")
    return placed.join(starts, [*by, *ranks, "_cell"]).withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_start", "_cell", *ranks)


def targets(n: int, shards: int) -> list[int]:
    """Rows of each shard."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def quotas(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes from one shard to another are granted, so that no shard gets more than it has room for.

    Two shards exchange as many as both wish; the room of a shard is shared among the rest in proportion."""
    swap = {(s, t): min(n, wishes.get((t, s), 0)) for (s, t), n in wishes.items()}
    out = dict(swap)
    for t, free in enumerate(room):
        rest = {st: n - swap[st] for st, n in wishes.items() if st[1] == t and n > swap[st]}
        whole = sum(rest.values())
        given = rest if whole <= free else {st: n * free // whole for st, n in rest.items()}
        left = min(free, whole) - sum(given.values())
        for st in sorted(rest, key=lambda st: (-rest[st], st)):
            more = min(left, rest[st] - given[st], 1)
            out[st] += given[st] + more
            left -= more
    return out


def _neighbours(members: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(group, near): the members of each group by shard."""
    placed = members.join(labels, "node").groupBy("group")
    return placed.agg(F.array(*(F.count(F.when(F.col("shard") == s, 1)) for s in range(shards))).alias("near"))


def _cut(near: DataFrame, shards: int) -> int:
    """Links between different shards: of each group all pairs without those within a shard."""
    sizes = [F.col("near")[s] for s in range(shards)]
    whole = sum(sizes[1:], sizes[0])
    same = sum((n * n for n in sizes[1:]), sizes[0] * sizes[0])
    return int(near.agg(F.sum((whole * whole - same).cast("decimal(38,0)"))).first()[0] or 0) // 2


def cut_links(members: DataFrame, labels: DataFrame, shards: int = SHARDS) -> int:
    """Number of linked pairs (counted in every group that both are members of) whose shards differ."""
    return _cut(_neighbours(members, labels, shards), shards)


def _wishes(members: DataFrame, labels: DataFrame, near: DataFrame, shards: int, allowed: list[bool]) -> DataFrame:
    """(node, shard, to, gain) of the members that wish to move."""
    held = members.join(near, "group").groupBy("node").agg(F.array(*(F.sum(F.col("near")[s]) for s in range(shards))).alias("near"), F.min("group").alias("tie"))
    choices = [
        F.when(F.lit(allowed[s]) | (F.col("shard") == s), F.struct(F.col("near")[s].alias("n"), F.lit(allowed[s]).alias("open"), F.xxhash64("tie", F.lit(s)).alias("tie"), F.lit(s).alias("to")))
        for s in range(shards)
    ]
    best = held.join(labels, "node").withColumn("best", F.array_max(F.array(*choices)))
    return best.select("node", "shard", F.col("best.to").alias("to"), (F.col("best.n") - F.col("near")[F.col("shard")]).alias("gain")).where("to <> shard")


def propagate(members: DataFrame, n: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of every member of ``members`` (node long, group), a table that can be read again.

    ``n`` is the number of rows to be dealt in all, members or not; no shard gets more members than its share of these."""
    nodes = members.select("node").distinct()
    many = nodes.count()
    cells, share = _cells(members, many), targets(n, shards)
    labels = best = stored(_counted(nodes, [], [], cells, "at").select("node", F.pmod("at", F.lit(shards)).cast("int").alias("shard")), "shards-labels")
    sizes = targets(many, shards)
    least, idle, turn = None, 0, 0
    while many:
        near = stored(_neighbours(members, labels, shards), "shards-near")
        cut = _cut(near, shards)
        if least is None or cut < least:
            if best is not labels:
                discard(best)
            least, best, idle = cut, labels, 0
        else:
            idle += 1
        if cut == 0 or idle == 2 or turn == rounds:
            discard(near)
            break
        room = [a - b for a, b in zip(share, sizes)]
        wishes = stored(_wishes(members, labels, near, shards, [idle == 1 or r > 0 for r in room]), "shards-wishes")
        found = {(r.shard, r.to): r.n for r in wishes.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        granted = quotas(found, room)
        after = labels
        if any(granted.values()):
            pairs = [(s, t) for s in range(shards) for t in range(shards)]
            quota = F.array(*(F.lit(granted.get(st, 0)).cast("long") for st in pairs))[F.col("shard") * shards + F.col("to")]
            whole = F.array(*(F.lit(granted.get(st, 0) >= found.get(st, 0)) for st in pairs))[F.col("shard") * shards + F.col("to")]
            # The greatest gains first, by powers of two; pairs of shards that get all they wish need no ranks.
            ranked = _counted(wishes.where(~whole & (quota > 0)), ["shard", "to"], [-F.floor(F.log2(F.col("gain") + 1)).cast("int")], cells, "at").where(F.col("at") < quota)
            moves = wishes.where(whole).select("node", "to").union(ranked.select("node", "to"))
            after = stored(labels.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "shards-labels")
            for (s, t), q in granted.items():
                sizes[s], sizes[t] = sizes[s] - q, sizes[t] + q
        discard(near)
        discard(wishes)
        if after is not labels and labels is not best:
            discard(labels)
        labels, turn = after, turn + 1
    if labels is not best:
        discard(labels)
    return best


def dealt(rows: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with a unique long ``node``) with ``shard`` and ``slot``; members as in :func:`propagate`.

    Members come first in a shard; rows without links fill it up."""
    n = rows.count()
    labels, share = propagate(members, n, shards, rounds), targets(n, shards)
    sizes = dict(map(tuple, labels.groupBy("shard").agg(F.count("*")).collect()))
    cells = _cells(rows, n)
    first = _counted(labels, ["shard"], [], cells, "slot").select("node", "shard", "slot")
    placed = stored(rows.join(first, "node", "left"), "shards-placed")
    gaps = [share[s] - sizes.get(s, 0) for s in range(shards)]
    ends = [sum(gaps[: s + 1]) for s in range(shards)]
    loose = _counted(placed.where("shard is null").drop("shard", "slot"), [], [], cells, "at")
    # The shard whose gap holds the place: as many gaps as end at or before it are full.
    shard = sum((F.when(F.col("at") >= e, 1).otherwise(0) for e in ends[1:]), F.when(F.col("at") >= ends[0], 1).otherwise(0))
    starts = F.array(*(F.lit(sizes.get(s, 0) - (ends[s] - gaps[s])).cast("long") for s in range(shards)))
    filled = loose.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("at") + starts[F.col("shard")]).drop("at")
    return placed.where("shard is not null").unionByName(filled)


def document_rows(docs: DataFrame) -> DataFrame:
    """(node, doc_id, size, text_crc32, group), written, so that ``node`` numbers every row once and for all.

    The group is the MD5 digest of the text; two texts that share it would only be put together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = picked(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"))
    return stored(narrow.withColumn("node", F.monotonically_increasing_id()), "shards-rows")


def equal_texts(rows: DataFrame) -> DataFrame:
    """(node, group) of the rows whose group has another row."""
    groups = stored(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "shards-groups")
    return stored(rows.select("node", "group").join(groups, "group", "left_semi").select("node", "group"), "shards-members")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    The law is ``rows``: the shards' numbers of rows differ by one at most; ``grown_shard`` is null, as it
    belongs to another law. ``size`` is the text's length in UTF-8 bytes and one.

    A null text counts as empty, and such rows are a group like any; a null or repeated doc_id is harmless, as rows
    are told apart by a number of their own; repeated rows each have a slot; a group larger than a shard is spread over
    as few shards as there is room for; ties go by a hash of the group; other columns are harmless; an empty table gives no rows."""
    rows = document_rows(docs)
    placed = dealt(rows, equal_texts(rows), shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
