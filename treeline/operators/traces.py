"""Trajectories, call logs and budgets as tables of ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.ranking import ranked


def trial_table(episodes: DataFrame, by: list[str], verdict: str, numbers: list[str]) -> DataFrame:
    """Per group: cases by verdict, and medians over what is a number."""
    return episodes.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.count_if(F.col(verdict) == v).alias(v) for v in ("success", "failure", "unavailable")), *(F.median(n).alias(f"median_{n}") for n in numbers)
    )


def usage_totals(calls: DataFrame, by: list[str], usage: str) -> DataFrame:
    """Sums of a map's values by key; null values count for nothing."""
    return calls.select(*by, F.explode(usage).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))


def throughput(stages: DataFrame, episodes: str, seconds: str) -> DataFrame:
    return stages.withColumn("per_minute", F.col(episodes) * 60.0 / F.greatest(F.col(seconds), F.lit(0.001)))


def stage_health(stages: DataFrame) -> DataFrame:
    """reasons in order: too few episodes, infrastructure errors, episodes without annotation, no attempts, too many refusals."""
    return stages.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("episodes") < 2, "fewer than two episodes"), F.when(F.col("infra_errors") > 0, "infrastructure error"), F.when(F.col("annotated") < F.col("episodes"), "annotation missing"),
        F.when(F.col("attempts") == 0, "no attempts"), F.when(F.col("refused") > 0.25 * F.col("attempts"), "too many refusals"),
    ))).withColumn("healthy", F.size("reasons") == 0)


def history(steps: DataFrame, by: str, order: str, value: str, n: int = 8) -> DataFrame:
    """Adds history: the values of the n steps before."""
    return steps.withColumn("history", F.collect_list(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)))


def first_seen_ids(steps: DataFrame, by: str, order: str, payload: Column, prefix: str = "o") -> DataFrame:
    """Adds an id that numbers distinct payloads of a group by first appearance, from 1."""
    digest = F.sha2(payload, 256)
    first = steps.withColumn("_h", digest).withColumn("_f", F.min(order).over(Window.partitionBy(by, "_h")))
    return first.withColumn("id", F.concat(F.lit(prefix), F.dense_rank().over(Window.partitionBy(by).orderBy("_f")).cast("string"))).drop("_h", "_f")


def pages(items: DataFrame, by: str, order: str, size: int = 12) -> DataFrame:
    """Adds page (from 0), place on it, and pages in all (one at least)."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    return items.withColumns({"page": F.floor(rn / size).cast("int"), "place": (rn % size).cast("int"), "n_pages": F.greatest(F.lit(1), F.ceil(n / size).cast("int"))})


def stage_delta(rows: DataFrame, by: str, order: str, value: str, ok: Column) -> DataFrame:
    """Adds saved: how much less the value is than that of the last successful row before."""
    before = F.last(F.when(ok, F.col(value)), ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("saved", F.when(ok, before - F.col(value)))


def reading_words(text: Column) -> Column:
    """Words between white space."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def admission_ledger(requests: DataFrame, cap: int, gap_s: float) -> DataFrame:
    """Replays a shared budget over requests (request, model, ts seconds): admitted in order until cap, each model's starts gap_s apart.

    start is when a request may begin. Waiting uses nothing up.
    """
    placed = ranked(requests.select("request", "model", "ts"), ["ts", "request"], "place")
    inside = placed.where(F.col("place") <= cap)
    # start_i = max over j <= i of ts_j + (i - j) * gap: a running maximum of ts_j - j * gap
    w = Window.partitionBy("model").orderBy("place")
    nth = F.row_number().over(w)
    start = F.max(F.col("ts") - F.col("nth") * gap_s).over(w) + F.col("nth") * gap_s
    inside = inside.withColumn("nth", nth).withColumn("start", start).drop("nth")
    return inside.withColumn("admitted", F.lit(True)).unionByName(placed.where(F.col("place") > cap).withColumns({"start": F.lit(None).cast("double"), "admitted": F.lit(False)}))


#: Roles that a user fills, activates and orients by.
FILL_ROLES = ["textbox", "searchbox", "combobox", "spinbutton"]
ACTIVATE_ROLES = [
    *FILL_ROLES, "button", "link", "checkbox", "radio", "switch", "tab", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "treeitem", "slider", "listbox", "select", "disclosuretriangle",
]
LANDMARK_ROLES = ["banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search", "dialog", "alertdialog"]


class Reader:
    """A reader of grouped items: a stack of places, a page, and accounts of what was shown.

    Besides the hierarchy it lists the source, and all headings, landmarks or
    controls of it (roles: item to role, in document order; items without roles
    are groups). An invalid action raises ValueError and charges nothing.
    """

    def __init__(self, children: dict[str, list[str]], labels: dict[str, str], page_size: int = 12, roles: dict[str, str] | None = None):
        self.children, self.labels, self.size, self.roles = children, labels, page_size, roles or {}
        self.stack, self.page = ["root"], 0
        self.words = self.choices = self.moves = self.actions = self.observations = 0
        held = {c for own in children.values() for c in own}
        self.lists = {
            ":source": [i for i in self.roles if i not in held or i in children.get("root", [])], ":headings": [i for i, r in self.roles.items() if r == "heading"],
            ":landmarks": [i for i, r in self.roles.items() if r in LANDMARK_ROLES], ":controls": [i for i, r in self.roles.items() if r in ACTIVATE_ROLES],
        }

    def _all(self) -> list[str]:
        return self.lists.get(self.stack[-1], self.children.get(self.stack[-1], []))

    def items(self) -> list[str]:
        return self._all()[self.page * self.size : (self.page + 1) * self.size]

    def observe(self) -> list[str]:
        shown = self.items()
        self.observations += 1
        self.choices += len(shown)
        self.words += sum(len(self.labels.get(i, i).split()) for i in shown)
        return shown

    def _on_page(self, target: str | None) -> str:
        """The item that a target names, with or without the mark of its kind; it has to stand on the page, once."""
        shown = [i for i in self.items() if target in (i, i.partition(":")[2] if ":" in i else i)]
        if len(shown) != 1:
            raise ValueError(f"{target} is not on this page, or not alone")
        return shown[0]

    def act(self, action: str, target: str | None = None) -> list[str]:
        if action == "expand":
            item = self._on_page(target)
            if not self.children.get(item):
                raise ValueError(f"{target} cannot be expanded here")
            self.stack, self.page = [*self.stack, item], 0
        elif f":{action}" in self.lists:
            self.stack, self.page = [*self.stack, f":{action}"], 0
        elif action == "up":
            if len(self.stack) == 1:
                raise ValueError("at the root")
            self.stack, self.page = self.stack[:-1], 0
        elif action in ("next", "previous"):
            new = self.page + (1 if action == "next" else -1)
            if not 0 <= new < max(1, -(-len(self._all()) // self.size)):
                raise ValueError("no such page")
            self.page = new
        elif action in ("activate", "fill"):
            role = self.roles.get(self._on_page(target))
            if self.roles and role not in (FILL_ROLES if action == "fill" else ACTIVATE_ROLES):
                raise ValueError(f"{target} takes no {action}")
            self.actions += 1
            return self.observe()
        else:
            raise ValueError(f"unknown action {action}")
        self.moves += 1
        return self.observe()


def replay(actions: DataFrame, items: DataFrame, page_size: int = 12) -> DataFrame:
    """One row per session: what a Reader counted over its actions (session, step, action, target) on items (session, parent, item, ord, label, and role if actions depend on it).

    A session is replayed by one task, step by step, since each action depends on the ones before.
    """

    def run(key: tuple, acts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ord")
        roles = {i: r for i, r in zip(own["item"], own["role"], strict=True) if isinstance(r, str)} if "role" in own else None
        reader = Reader({p: g["item"].tolist() for p, g in own.groupby("parent")}, dict(zip(own["item"], own["label"], strict=True)), page_size, roles)
        errors = 0
        reader.observe()
        for a in acts.sort_values("step").itertuples():
            try:
                reader.act(a.action, a.target)
            except ValueError:
                errors += 1
        return pd.DataFrame([{"session": key[0], "words": reader.words, "choices": reader.choices, "observations": reader.observations, "moves": reader.moves, "actions": reader.actions, "errors": errors}])

    schema = "session long, words long, choices long, observations long, moves long, actions long, errors long"
    return actions.groupBy("session").cogroup(items.groupBy("session")).applyInPandas(run, schema)


def framed_lines(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines of a growing log that end with a line feed; what is behind the last one waits. An empty line is an error."""
    rest = b""
    for chunk in chunks:
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            if not line:
                raise ValueError("an empty line")
            yield line.decode()


def episode_outcomes(steps: DataFrame, max_steps: int, max_actions: int, max_seconds: float) -> DataFrame:
    """Per episode over steps (episode, step, kind, seconds, error): counts, and how it ended: error, stopped, step_limit, action_limit, time_limit or open.

    An episode ends at the first step that fails, stops or reaches a limit; later steps do not count.
    """
    w = Window.partitionBy("episode").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({"_n": F.count("*").over(w), "_a": F.sum((F.col("kind") == "action").cast("int")).over(w), "_s": F.sum("seconds").over(w)})
    end = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("kind") == "stop", "stopped").when(F.col("_n") >= max_steps, "step_limit")
        .when(F.col("_a") >= max_actions, "action_limit").when(F.col("_s") >= max_seconds, "time_limit")
    )
    run = run.withColumn("_end", end).withColumn("_over", F.max(F.col("_end").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    counted = run.where(~F.coalesce("_over", F.lit(False)))
    return counted.groupBy("episode").agg(F.count("*").alias("steps"), F.sum((F.col("kind") == "action").cast("int")).alias("actions"), F.sum("seconds").alias("seconds"), F.coalesce(F.max("_end"), F.lit("open")).alias("status"))
