"""Texts made of rows: catalog, checkpoints, snapshot, debug documents; and the catalog read back."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import text
from stratalith.operators import surface

PARENT_LINE = r"^\s*##\s+\[\[([^\]]+)\]\]\s+\[parent\]\s+\[([^\]]+)\]\s+\[seq\s+([^\]]+)\]"
ENTRY_LINE = r"^\s*-\s+(\[cache\]\s+)?\[\[([^\]]+)\]\]\s+(?:\[seq\s+([^\]]+)\]|\[([^\]]+)\])\s*(.*)$"


def catalog(selected: DataFrame, budget: int | None = None) -> DataFrame:
    """``query_id, catalog``: whole parents in order of ``pick``, each under a heading with id, layer and sequence range.

    With a ``budget`` of tokens only parents that still fit; none is cut.
    """
    if budget is not None:
        selected = surface.skipping(selected, ["query_id"], ["pick"], text.estimate_tokens(F.col("view")) + 24, F.lit(budget)).filter("accepted").drop("accepted")
    span = F.concat(F.coalesce(F.col("first_seq").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("last_seq").cast("string"), F.lit("?")))
    block = F.concat(F.lit("## [[chunk:"), "parent_id", F.lit("]] [parent] ["), "layer", F.lit("] [seq "), span, F.lit("]\n"), "view")
    rows = selected.withColumn("block", block).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pick", "block"))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return rows.select("query_id", F.concat(F.lit("<memory-parents>\n"), body, F.lit("\n</memory-parents>")).alias("catalog"))


def parse_catalog(rows: DataFrame) -> DataFrame:
    """``query_id, line_no, name, layer, seq, cached, summary`` of the entries of a catalog."""
    lines = rows.select("query_id", F.posexplode(F.split("catalog", r"\r?\n")).alias("line_no", "line"))
    got = lambda p, i: F.nullif(F.trim(F.regexp_extract("line", p, i)), F.lit(""))
    parent, entry = F.col("line").rlike(PARENT_LINE), F.col("line").rlike(ENTRY_LINE)
    layer = F.when(parent, got(PARENT_LINE, 2)).otherwise(got(ENTRY_LINE, 4))
    return lines.filter(parent | entry).select(
        "query_id", "line_no", F.when(parent, got(PARENT_LINE, 1)).otherwise(got(ENTRY_LINE, 2)).alias("name"), layer.alias("layer"),
        F.when(parent, got(PARENT_LINE, 3)).otherwise(got(ENTRY_LINE, 3)).alias("seq"), F.when(parent, layer == "cache").otherwise(got(ENTRY_LINE, 1).isNotNull()).alias("cached"),
        F.when(parent, F.lit("Parent current view")).otherwise(got(ENTRY_LINE, 5)).alias("summary"),
    )


def resolve_entries(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Catalog entries with the parent they name: by ``chunk:id``, by id, or by label; three equi-joins, the first that hits."""
    names = parents.select(F.concat(F.lit("chunk:"), "parent_id").alias("name"), "parent_id", F.lit(0).alias("way"))
    names = names.unionByName(parents.select(F.col("parent_id").alias("name"), "parent_id", F.lit(1).alias("way"))).unionByName(parents.select(F.col("label").alias("name"), "parent_id", F.lit(2).alias("way")))
    best = names.groupBy("name").agg(F.min_by("parent_id", F.struct("way", "parent_id")).alias("parent_id"))
    return entries.join(best, "name", "left")


def checkpoint(key: Column, first: Column, last: Column, core: Column, children: Column, model: Column, dims: Column, refs: Column) -> Column:
    preview = F.substring(F.regexp_replace(text.nonblank(core), r"(?U)\s+", " "), 1, 240)
    return F.concat(
        F.lit("[[chunk:"), key, F.lit("]] [span "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("]\n"), preview, F.lit("\n[children: "), F.coalesce(children, F.lit(0)).cast("string"),
        F.lit("; vector: "), F.coalesce(model, F.lit("pending")), F.lit(" / "), F.coalesce(dims, F.lit(0)).cast("string"), F.lit("d]\n[sourceRefs: "), F.array_join(F.transform(refs, lambda r: r.cast("string")), ", "), F.lit("]"),
    )


def pointer(key: Column, refs: Column) -> Column:
    return F.concat(F.lit("[[chunk:"), key, F.lit("]] moved to the session's snapshot. [sourceRefs: "), F.array_join(F.transform(refs, lambda r: r.cast("string")), ", "), F.lit("]"))


#: Whose lines a snapshot takes first (fixed order): speaker, and the fact that must hold.
PRECEDENCE = (("user", None), ("assistant", "text"), ("tool", "trusted"), ("tool", None))


def record_priority(role: Column, kinds: Column, trusted: Column) -> Column:
    facts = {None: F.lit(True), "text": F.array_contains(kinds, "text"), "trusted": trusted}
    ranks = [F.when((role == who) & facts[fact], F.lit(i)) for i, (who, fact) in enumerate(PRECEDENCE)]
    return F.coalesce(*ranks, F.lit(len(PRECEDENCE)))


NON_ASCII = re.compile(r"[^\x00-\x7f]")


def grown(state: tuple[int, int], part: str) -> tuple[int, int]:
    """Token estimate of a text that grows: tokens of what is closed, and the length of the ASCII run at its end."""
    closed, run = state
    at = 0
    for wide in NON_ASCII.finditer(part):
        closed, run, at = closed + (run + wide.start() - at + 3) // 4 + 1, 0, wide.end()
    return closed, run + len(part) - at


def tokens(s: str) -> int:
    """Python form of the token estimate, for functions that already run in Python."""
    closed, run = grown((0, 0), s)
    return closed + (run + 3) // 4


def fitting_lines(lines: DataFrame) -> DataFrame:
    """The lines of each record that its budget has room for, of ``session_id, record_id, priority, seq, line, budget``.

    Lines are read in order of priority and number, as one stream per record; one that doesn't fit is passed over, but a
    record's first line always stays (it is shortened beforehand). Kept lines count as joined by line ends.
    """
    keys = ["session_id", "record_id"]
    rows = lines.repartition(*keys).sortWithinPartitions(*keys, "priority", "seq", "line")

    def run(batches):
        record, state = None, None
        for batch in batches:
            keep = []
            for *key, line, budget in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if key != record:
                    record, state = key, None
                after = grown(state or (0, 0), line if state is None else "\n" + line)
                fits = state is None or after[0] + (after[1] + 3) // 4 <= budget
                state = after if fits else state
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, lines.schema)


def snapshot(records: DataFrame, budget: int) -> DataFrame:
    """``session_id, snapshot``: each record's lines within an equal part of the budget (at least 32 tokens).

    ``records`` has ``session_id, record_id, activated_at, rows`` (array of struct ``priority, seq, label, text``). A first
    line over its record's part is cut to the head and tail of its text. Records go in order of activation for as long as
    the budget lasts; the first one always does.
    """
    shares = records.groupBy("session_id").agg(F.greatest(F.lit(32), F.floor(F.lit(budget) / F.count("*"))).alias("budget"))
    rows = records.join(shares, "session_id").select("session_id", "record_id", "budget", F.posexplode(F.array_sort("rows")).alias("place", "r"))
    head = F.concat(F.lit("[seq "), F.col("r.seq").cast("string"), F.lit("] "), F.col("r.label"), F.lit(": "))
    body, room = text.nonblank(F.col("r.text")), F.greatest(F.lit(24), F.col("budget") * 3)
    front, back = F.floor(room * 0.65).cast("int"), F.floor(room * 0.25).cast("int")
    n = F.length(body)
    gap = n - F.least(n, front) - F.least(n, back)
    note = F.when(gap > 0, F.concat(F.lit("\n… omitted "), gap.cast("string"), F.lit(" chars …\n"), F.substring(body, n - F.least(n, back) + 1, back))).otherwise("")
    whole = F.concat(head, body)
    line = F.when((F.col("place") == 0) & (text.estimate_tokens(whole) > F.col("budget")), F.concat(head, F.substring(body, F.lit(1), front), note)).otherwise(whole)
    kept = fitting_lines(rows.select("session_id", "record_id", "r.priority", "r.seq", line.alias("line"), F.col("budget").cast("bigint").alias("budget")))
    parts = kept.groupBy("session_id", "record_id").agg(F.array_sort(F.collect_list(F.struct("priority", "seq", "line"))).alias("l"))
    part = F.concat(F.lit("## "), F.col("record_id"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    parts = parts.select("session_id", "record_id", part.alias("part")).join(records.select("session_id", "record_id", "activated_at"), ["session_id", "record_id"])
    order = [F.col("activated_at"), F.col("record_id")]
    taken = surface.stopping(parts, ["session_id"], order, text.estimate_tokens(F.col("part")), F.lit(budget)).filter("accepted")
    joined = taken.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("activated_at", "record_id", "part"))).alias("p"))
    return joined.select("session_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("snapshot"))


def write_document(df: DataFrame, root: str, path: str, form: str = "json") -> str:
    """Write a debug view below ``root``; a path that leaves it is refused. Returns where it was written."""
    where = PurePosixPath(path)
    if where.is_absolute() or ".." in where.parts:
        raise ValueError(f"{path} lies outside the workspace")
    target = f"{root.rstrip('/')}/{where}"
    (df.write.mode("overwrite").json(target) if form == "json" else df.select(F.concat(F.lit("- "), F.to_json(F.struct("*"))).alias("value")).write.mode("overwrite").text(target))
    return target
