"""Task graphs: validation, adjacency, levels and fail-fast outcomes.

Tasks are rows (dag, task, depends_on array).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(tasks: DataFrame) -> DataFrame:
    """(dag, parent, child) of every dependency."""
    return tasks.select("dag", F.explode("depends_on").alias("parent"), F.col("task").alias("child"))


def adjacency(tasks: DataFrame) -> DataFrame:
    """The children of each parent, in order of name."""
    return edges(tasks).groupBy("dag", "parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def roots(tasks: DataFrame) -> DataFrame:
    """Tasks that depend on nothing."""
    return tasks.where(F.coalesce(F.size("depends_on"), F.lit(0)) <= 0).select("dag", "task")


def problems(tasks: DataFrame) -> DataFrame:
    """(dag, problem, task): duplicate names, unknown parents and tasks that no order reaches (cycles)."""
    duplicate = tasks.groupBy("dag", "task").count().where("count > 1").select("dag", F.lit("duplicate").alias("problem"), "task")
    known = tasks.select("dag", F.col("task").alias("parent"))
    unknown = edges(tasks).join(known, ["dag", "parent"], "left_anti").select("dag", F.lit("unknown_parent").alias("problem"), F.col("parent").alias("task")).distinct()
    bad = duplicate.select("dag").union(unknown.select("dag")).distinct()
    sound = tasks.join(bad, "dag", "left_anti")
    cyclic = sound.select("dag", "task").join(levels(sound), ["dag", "task"], "left_anti").select("dag", F.lit("cycle").alias("problem"), "task")
    return duplicate.union(unknown).union(cyclic)


def _level(tasks: list[str], above: list[list[str] | None]) -> list[tuple[str, int]]:
    """Levels of one graph, by taking off the tasks without open parents round by round."""
    parents = {t: set(a) if a is not None else set() for t, a in zip(tasks, above, strict=True)}
    children: dict[str, list[str]] = {}
    for task, ups in parents.items():
        for parent in ups:
            children.setdefault(parent, []).append(task)
    open_ = {t: len(a) for t, a in parents.items()}
    out, now, level = [], [t for t, n in open_.items() if not n], 0
    while now:
        out += [(t, level) for t in now]
        after = []
        for task in now:
            for child in children.get(task, ()):
                open_[child] -= 1
                if not open_[child]:
                    after.append(child)
        now, level = after, level + 1
    return out


def levels(tasks: DataFrame) -> DataFrame:
    """(dag, task, level): 0 for roots, else one more than the deepest parent. Tasks on or behind a cycle have none.

    A graph is one document and is levelled whole; graphs are dealt out by id and run through in batches.
    """
    rows = tasks.select("dag", "task", "depends_on")
    kind = rows.schema["dag"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(frame: pd.DataFrame) -> pd.DataFrame:
            dag, task, above = (frame[c].tolist() for c in ("dag", "task", "depends_on"))
            cuts = [k for k in range(len(dag)) if not k or not same(dag[k], dag[k - 1])]
            out = [(dag[a], t, n) for a, b in zip(cuts, [*cuts[1:], len(dag)], strict=True) for t, n in _level(task[a:b], above[a:b])]
            return pd.DataFrame(out, columns=["dag", "task", "level"])

        def same(a: object, b: object) -> bool:
            return a == b or (pd.isna(a) and pd.isna(b))

        held: list[pd.DataFrame] = []
        for frame in frames:
            dags = frame["dag"]
            if held and not same(dags.iloc[-1], held[-1]["dag"].iloc[-1]):
                start = next(k for k in range(len(dags) - 1, -1, -1) if k == 0 or not same(dags.iloc[k - 1], dags.iloc[-1]))
                yield close(pd.concat([*held, frame.iloc[:start]], ignore_index=True))
                held = [frame.iloc[start:]]
            else:
                held.append(frame)
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return rows.repartition("dag").sortWithinPartitions("dag").mapInPandas(run, f"dag {kind}, task string, level int")


def ready(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """Pending tasks all of whose parents have succeeded."""
    state = status.select("dag", "task", "status")
    parents = edges(tasks).join(state.withColumnRenamed("task", "parent"), ["dag", "parent"], "left")
    met = parents.groupBy("dag", F.col("child").alias("task")).agg(F.bool_and(F.coalesce(F.col("status") == "success", F.lit(False))).alias("met"))
    pending = state.where("status = 'pending'").select("dag", "task")
    return pending.join(met, ["dag", "task"], "left").where(F.coalesce("met", F.lit(True))).select("dag", "task")


def fail_fast(outcomes: DataFrame) -> DataFrame:
    """Final status of each task (dag, task, level, outcome): those of a level beyond the first failed one are skipped."""
    first = F.min(F.when(F.col("outcome") == "failed", F.col("level"))).over(Window.partitionBy("dag"))
    return outcomes.withColumn("first_failed", first).select(
        "dag", "task", "level", F.when(F.col("level") > F.col("first_failed"), "skipped").otherwise(F.col("outcome")).alias("status")
    )


#: Statuses that a task may go to from each status; the first is always the same (fixed values).
TRANSITIONS = {"": ("pending",), "pending": ("running", "skipped"), "running": ("success", "failed")}
#: Seconds that a command may take, and tasks that run at a time.
TIME_LIMIT, AT_ONCE = 30, 10


def outcome(runs: DataFrame, limit_s: int = TIME_LIMIT) -> DataFrame:
    """The outcome of each run (dag, task, exit_code, check_code, seconds): failed for a command that fails or takes too
    long, or a check that fails; a check runs only after a command that succeeds, and there may be none (null)."""
    done = (F.col("exit_code") == 0) & (F.col("seconds") <= limit_s)
    checked = done & F.col("check_code").isNotNull()
    good = F.coalesce(done, F.lit(False)) & F.coalesce(F.col("check_code") == 0, F.lit(True))
    return runs.select("dag", "task", F.coalesce(checked, F.lit(False)).alias("checked"), F.when(good, "success").otherwise("failed").alias("outcome"))


def transitions(events: DataFrame) -> DataFrame:
    """Whether each status of a task (dag, task, event_seq, status) may follow the one before."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("dag", "task").orderBy("event_seq")), F.lit(""))
    allowed = F.lit(False)
    for status, after in TRANSITIONS.items():
        allowed = allowed | ((before == status) & F.col("status").isin(*after))
    return events.select("dag", "task", "event_seq", "status", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def rounds(waiting: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """The round in which each waiting task (dag, level, task) starts, at most ``at_once`` of a level at a time, by name."""
    place = F.row_number().over(Window.partitionBy("dag", "level").orderBy("task"))
    return waiting.select("dag", "level", "task", F.floor((place - 1) / at_once).cast("long").alias("round"))


def summary(results: DataFrame) -> DataFrame:
    """Passed, failed and all results (suite, passed, seconds) of each suite, and the seconds they took."""
    return results.groupBy("suite").agg(
        F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"), F.sum("seconds").alias("seconds"),
    )
