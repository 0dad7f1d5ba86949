"""Filling fixed-capacity containers (problem 8): vector bin packing by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.tokens import encoder, shipped
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, tokens, loss): the size of each text in tokens of the tokenizer and how many of them bear loss.

    In a text of several lines the words that begin in the first are the prompt, whose tokens bear none; in a text of one
    line all tokens do. A text is encoded once. Null and empty texts have size 0."""
    name = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = bpe.counts(batch.column(1).to_pylist())
                sizes, loss = pa.array([n for n, _ in counts], pa.int32()), pa.array([n - p for n, p in counts], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, loss], names=["doc_id", "tokens", "loss"])

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, tokens int, loss int")


#: Items among which a container's next one is chosen.
WINDOW = 64


def pack(demand: np.ndarray, limits: np.ndarray, window: int = WINDOW, dimensions: int | None = None) -> np.ndarray:
    """The container number of each item. ``demand``: whole numbers, items by dimensions, none above ``limits``.

    One container is open at a time. It begins with the item that has waited longest and then takes, as long as one of the
    next ``window`` items fits in all dimensions, the one whose demand (as a share of the limits) has the largest dot product
    with the room that is left. So large items don't run out before the small ones, of which a container holds few, and every
    container gets both. ``dimensions``: the dot product looks only at the first so many, to measure what the others do."""
    size, dims = demand.shape
    out = np.zeros(size, np.int64)
    if not size:
        return out
    window, used = min(window, size), dims if dimensions is None else dimensions
    whole = limits.astype(np.int64)
    held, shares = demand[:window].astype(np.int64), (demand / limits)[:, :used]
    share = shares[:window].copy()
    waiting = np.arange(window)  # the items in the window; those gone count as ``size``
    ahead, number, left = window, -1, size
    gone = whole + 1  # fits nowhere

    def take(slot: int) -> None:
        nonlocal ahead, left
        out[waiting[slot]] = number
        left -= 1
        if ahead < size:
            waiting[slot], held[slot], share[slot] = ahead, demand[ahead], shares[ahead]
            ahead += 1
        else:
            waiting[slot], held[slot] = size, gone

    while left:
        number += 1
        slot = int(waiting.argmin())
        room = whole - held[slot]
        take(slot)
        while left:
            fits = held[:, 0] <= room[0]
            for d in range(1, dims):
                fits &= held[:, d] <= room[d]
            score = np.where(fits, share @ (room / whole)[:used], -1.0)
            slot = int(score.argmax())
            if score[slot] < 0:
                break
            room = room - held[slot]
            take(slot)
    return out


def first_fit(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The plain rule that ``pack`` is measured against: each item goes into the first container that has room."""
    out, room, number = np.zeros(len(demand), np.int64), np.tile(limits, (len(demand), 1)), 0
    for i, item in enumerate(demand):
        fits = (room[:number] >= item).all(1)
        k = int(fits.argmax()) if fits.any() else number
        number = max(number, k + 1)
        room[k] -= item
        out[i] = k
    return out


#: Kinds of containers are listed in the plan; more than these raise ValueError.
MOST_KINDS = 1000


def _packer(round_no: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("nr", "ascending")])
        capacity = table.column("capacity")[0].as_py()
        limits = np.array([capacity, table.column("segments")[0].as_py(), table.column("loss_limit")[0].as_py()], np.int64)
        tokens, loss = (table.column(c).to_numpy().astype(np.int64) for c in ("tokens", "loss"))
        # an item that alone bears more loss than the limit leaves no room for any other that bears some
        number = pack(np.column_stack([tokens, np.ones_like(tokens), np.minimum(loss, limits[2])]), limits)
        kind, group = table.column("container_kind")[0].as_py(), table.column("grp")[0].as_py()
        names = [f"{kind}-{round_no}-{group}-{n}" for n in number.tolist()]
        filled = np.bincount(number, weights=tokens)[number]
        arrays = [table.column("container_kind"), pa.array(names, pa.string()), *(table.column(c) for c in ("doc_id", "piece", "nr", "tokens", "loss", "over_limit", "segments", "loss_limit"))]
        return pa.Table.from_arrays(
            [*arrays, pa.array(filled / capacity, pa.float64()), table.column("capacity")],
            names=["container_kind", "container_id", "doc_id", "piece", "nr", "tokens", "loss", "over_limit", "segments", "loss_limit", "fill", "capacity"],
        )

    return run


def filled_containers(
    sizes: DataFrame,
    containers: DataFrame,
    segment_slack: float = 2.0,
    loss_slack: float = 1.2,
    group_rows: int = 8192,
    poor: float = 0.97,
    rounds: int = 3,
) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens, loss, over_limit, capacity, segments, loss_limit): where each
    text goes, for each kind of container, and the limits of that kind.

    ``sizes``: (doc_id, tokens, loss); ``containers``: (container_kind, capacity_tokens), few rows. A text is split into
    pieces of the capacity only if it alone exceeds it. A container holds at most its capacity in tokens, ``segments`` pieces
    and ``loss_limit`` loss-bearing tokens. Both limits come from the data: what a full container of average content has,
    times ``segment_slack`` and ``loss_slack``, at most the capacity. As a text within the capacity is never split, a piece
    that alone bears more loss than the limit is kept whole, comes out with its own number and ``over_limit``, and shares its
    container only with pieces that bear none. Texts without tokens need no room: they come out with piece 0 and a null
    container_id; so do texts of null id, which are packed like others. Repeated rows are items of their own. Capacities that
    are null or below 1 hold nothing and give no rows.

    Items are dealt by hash to groups of about ``group_rows`` rows, which are packed apart, in parallel and in bounded
    memory. Items of containers filled below ``poor`` are dealt anew, together, to fewer groups and packed again,
    ``rounds`` times in all. What is left unused in the end is that of the last containers of the last groups.
    """
    kinds = [tuple(r) for r in containers.where("capacity_tokens >= 1 and container_kind is not null").select("container_kind", F.col("capacity_tokens").cast("bigint")).distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    listed = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds))) if kinds else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    numbered = sizes.withColumn("nr", F.monotonically_increasing_id()).where("tokens > 0")
    each = numbered.select("doc_id", "nr", "tokens", "loss", F.inline(listed))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    size = F.least(F.col("tokens") - start, F.col("capacity"))
    prompt = F.col("tokens") - F.col("loss")  # stands first
    loss = F.least(size, F.greatest(F.lit(0), start + size - prompt))
    items = pieces.select("container_kind", "capacity", "doc_id", "nr", "piece", size.cast("int").alias("tokens"), loss.cast("int").alias("loss"))
    content = items.groupBy("container_kind", "capacity").agg(F.count("*").alias("c"), F.sum("tokens").alias("t"), F.sum("loss").alias("l"))
    at_most = lambda n, slack: F.least(F.col("capacity"), F.greatest(F.lit(1), F.ceil(F.col("capacity") * F.col(n) / F.col("t") * F.lit(slack))))
    limits = F.broadcast(content.select("container_kind", "capacity", at_most("c", segment_slack).alias("segments"), at_most("l", loss_slack).alias("loss_limit")))  # a row for each kind
    items = items.join(limits, ["container_kind", "capacity"]).withColumn("over_limit", F.col("loss") > F.col("loss_limit"))
    columns = ["container_kind", "capacity", "doc_id", "nr", "piece", "tokens", "loss", "over_limit", "segments", "loss_limit"]
    out: DataFrame | None = None
    for r in range(rounds):
        n = items.groupBy("container_kind", "capacity").agg(F.count("*").alias("n"))
        grouped = items.join(F.broadcast(n), ["container_kind", "capacity"])  # a row for each kind
        groups = F.ceil(F.col("n") / F.lit(group_rows))
        grouped = grouped.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "nr", F.lit(r)), groups)).drop("n")
        placed = grouped.groupBy("container_kind", "capacity", "grp").applyInArrow(
            _packer(r),
            "container_kind string, container_id string, doc_id bigint, piece int, nr bigint, tokens int, loss int, over_limit boolean, segments bigint, loss_limit bigint, fill double, capacity bigint",
        )
        placed = staged(placed, f"packed{r}")
        good = placed if r == rounds - 1 else placed.where(F.col("fill") >= poor)
        out = good if out is None else out.unionByName(good)
        items = placed.where(F.col("fill") < poor).select(*columns)
    shown = ["container_kind", "container_id", "doc_id", "piece", "tokens", "loss", "over_limit", "capacity", "segments", "loss_limit"]
    types = dict(out.dtypes)
    fixed = {"doc_id": F.col("doc_id"), "piece": F.lit(0), "tokens": F.lit(0), "loss": F.lit(0), "over_limit": F.lit(False)}
    empty = sizes.where("tokens = 0").select(*(fixed.get(c, F.lit(None)).cast(types[c]).alias(c) for c in shown))
    return out.select(*shown).unionByName(empty)


def fill_figures(filled: DataFrame) -> DataFrame:
    """(container_kind, containers, items, fill, most_tokens, most_segments, most_loss, over_limit, segments, loss_limit): how
    full the containers of each kind are on the whole, and the most that one holds; ``most_loss`` leaves out containers with a
    piece over the limit, ``over_limit`` counts those."""
    each = filled.where("container_id is not null").groupBy("container_kind", "container_id").agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.bool_or("over_limit").alias("over"),
        F.max("capacity").alias("capacity"), F.max("segments").alias("segments"), F.max("loss_limit").alias("loss_limit"),
    )
    return each.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.round(F.sum("tokens") / F.sum("capacity"), 4).alias("fill"), F.max("tokens").alias("most_tokens"),
        F.max("items").alias("most_segments"), F.max(F.when(~F.col("over"), F.col("loss"))).alias("most_loss"), F.count_if("over").alias("over_limit"),
        F.max("segments").alias("segments"), F.max("loss_limit").alias("loss_limit"),
    )


def p8_filled(spark, sf_dir: str) -> DataFrame:
    """Every text of documents in containers of every kind."""
    sizes = staged(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return filled_containers(sizes, spark.read.parquet(f"{sf_dir}/containers.parquet"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """How full the containers of ``p8_filled`` are."""
    return fill_figures(p8_filled(spark, sf_dir))


def broken_rules(filled: DataFrame, sizes: DataFrame) -> DataFrame:
    """(container_kind, documents, incomplete, over_tokens, over_segments, over_loss, split): how many documents are placed, of
    how many the pieces don't add up to the text, how many containers break a limit (a piece over the limit on loss may share
    one with pieces that bear none), and how many texts within the capacity are split."""
    rows = filled.where("container_id is not null")
    each = rows.groupBy("container_kind", "container_id").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("c"), F.sum("loss").alias("l"), F.sum(F.when(~F.col("over_limit"), F.col("loss")).otherwise(0)).alias("rest"), F.count_if("over_limit").alias("over"),
        F.max("capacity").alias("capacity"), F.max("segments").alias("segments"), F.max("loss_limit").alias("loss_limit"),
    )
    loss = F.when(F.col("over") == 0, F.col("l") > F.col("loss_limit")).otherwise((F.col("over") > 1) | (F.col("rest") > 0))
    limits = each.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity")).alias("over_tokens"), F.count_if(F.col("c") > F.col("segments")).alias("over_segments"), F.count_if(loss).alias("over_loss"))
    whole = rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max("capacity").alias("capacity"))
    of = whole.join(sizes.select("doc_id", F.col("tokens").alias("size")), "doc_id")
    texts = of.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(F.col("t") != F.col("size")).alias("incomplete"), F.count_if((F.col("size") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("split"))
    return texts.join(limits, "container_kind").select("container_kind", "documents", "incomplete", "over_tokens", "over_segments", "over_loss", "split")


def p8_broken(spark, sf_dir: str) -> DataFrame:
    """Whether ``p8_filled`` places every text and keeps every rule."""
    sizes = staged(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    filled = staged(filled_containers(sizes, spark.read.parquet(f"{sf_dir}/containers.parquet")), "filled")
    return broken_rules(filled, sizes)


QUERIES = {"p8_filled": p8_filled, "p8_fill": p8_fill, "p8_broken": p8_broken}
_NONE = ", ".join(f"0::bigint as {c}" for c in ("incomplete", "over_tokens", "over_segments", "over_loss", "split"))
ORACLE = {"p8_broken": f"select container_kind, (select count(*) from documents where text <> '') as documents, {_NONE} from containers"}
