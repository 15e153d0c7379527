"""Label matching and label rewriting on a map column, or on labels promoted to columns.

A list of rewriting rules is compiled: label names are resolved while the plan is built, every rule works on
plain string expressions, and the map is written back once behind the last rule. Patterns that are plain
words become equalities, which reach the file scan for promoted columns. A missing label equals an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANYTHING = "(.*)"

#: Patterns that are one word, or several to choose from; no sign in them has a meaning.
_WORDS = re.compile(r"[\w/ :,@%=&~-]+(?:\|[\w/ :,@%=&~-]+)*", re.ASCII)
#: Name patterns that a target name can be read back through: a plain prefix and the rest, copied as it is.
_PREFIX = re.compile(r"([\w-]+)\(\.[+*]\)", re.ASCII)


def _get(labels: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def label(df: DataFrame, name: str, labels: str = "labels") -> Column:
    """A label's value; a missing label equals the empty string. Promoted columns win over the map."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return _get(F.col(labels), name)


def anchored(regex: str) -> str:
    return f"^(?:{regex})$"


def match_labels(df: DataFrame, eq: dict[str, str] | None = None, ne: dict[str, str] | None = None,
                 re: dict[str, str] | None = None) -> DataFrame:
    """Equality, inequality and fully anchored regex matchers; equality on promoted columns reaches the scan."""
    for name, value in (eq or {}).items():
        if name in df.columns and value != "":
            df = df.where(F.col(name) == value)
        else:
            df = df.where(label(df, name) == value)
    for name, value in (ne or {}).items():
        df = df.where(label(df, name) != value)
    for name, regex in (re or {}).items():
        df = df.where(label(df, name).rlike(anchored(regex)))
    return df


def metric_keep(df: DataFrame, regex: str, metric: str = "metric") -> DataFrame:
    return df.where(F.col(metric).rlike(anchored(regex)))


def label_values(df: DataFrame, name: str) -> DataFrame:
    """Sorted distinct non-empty values of a label."""
    return df.select(label(df, name).alias(name)).where(F.col(name) != "").distinct().orderBy(name)


class Compiler:
    """The labels of a frame while rules are applied to it.

    ``written`` names the hidden column that holds the value of each label a rule has set. Labels no rule has set are
    read from their own column, else from the map. A copy of all labels with a common prefix is kept as a note
    while names can be read back through it; any other copy works on the map at once.

    The optimizer copies the expression of a column into every filter above it, so a chain of rules on one label would grow
    with the power of its length. ``weight`` counts the copies; a value of too many is made opaque. Filters on
    labels that no rule has set are moved below all rules, where they can reach the scan.
    """

    #: Copies of an expression, at most, before it becomes opaque.
    HEAVY = 8

    def __init__(self, df: DataFrame):
        self.df = df
        self.promoted = [c for c in df.columns if c != "labels"]
        self.has_map = "labels" in df.columns
        self.written: dict[str, str] = {}
        self.copies: list[tuple[str, dict[str, str]]] = []
        self.count = 0
        self.weight: dict[str, int] = {}
        self.early: list[Column] = []
        self.steps: list[tuple[str | None, Column, set[str]]] = []
        self.touched: set[str] = set()
        self.looked_up: dict[str, str] = {}
        self.early_test = False

    def weigh(self, names: Sequence[str]) -> int:
        return sum(self.weight.get(n, 1) for n in names)

    def read(self, name: str, copies: int) -> Column:
        """The value of a label as the first copies leave it, rules that set labels one by one aside."""
        if copies:
            prefix, before = self.copies[copies - 1]
            source = prefix + name
            copied = self.hidden(before[source]) if source in before else self.read(source, copies - 1)
            return F.coalesce(F.nullif(copied, F.lit("")), self.read(name, copies - 1))
        if name in self.promoted:
            return label(self.df, name)
        return _get(F.col("labels"), name) if self.has_map else F.lit("")

    def hidden(self, column: str) -> Column:
        self.touched.add(column)
        return F.col(column)

    def value(self, name: str) -> Column:
        """The value of a label after the rules so far; empty where it is missing. A label is looked up once."""
        if name in self.written:
            return self.hidden(self.written[name])
        if self.early_test or not self.has_map or name in self.promoted:
            return self.read(name, len(self.copies))
        if name not in self.looked_up:
            touched, self.touched = self.touched, set()
            self.looked_up[name] = f"_label_{self.count}"
            self.count += 1
            self.step(self.looked_up[name], self.read(name, len(self.copies)))
            self.touched = touched
        return self.hidden(self.looked_up[name])

    def joined(self, source: Sequence[str], sep: str) -> Column:
        return self.value(source[0]) if len(source) == 1 else F.concat_ws(sep, *[self.value(s) for s in source])

    def test(self, source: Sequence[str], regex: str, sep: str) -> Column:
        """Whether the joined labels match; never null."""
        if len(source) == 1 and _WORDS.fullmatch(regex):
            words = regex.split("|")
            name = source[0]
            if name in self.promoted and name not in self.written and isinstance(self.df.schema[name].dataType, T.StringType):
                hit = F.col(name) == words[0] if len(words) == 1 else F.col(name).isin(words)
                return hit & F.col(name).isNotNull()
            value = self.value(name)
            return value == words[0] if len(words) == 1 else value.isin(words)
        text = self.joined(source, sep) if source else F.lit("")
        if regex in (ANYTHING, ".*"):
            return F.lit(True)
        if regex in ("(.+)", ".+", ""):
            return text == "" if regex == "" else text != ""
        return text.rlike(anchored(regex))

    def set(self, name: str, value: Column, weight: int = 1) -> None:
        """Give a label a value, in a hidden column of its own."""
        hidden = f"_label_{self.count}"
        self.count += 1
        if weight > self.HEAVY:
            value, weight = F.when(F.spark_partition_id() >= 0, value), 1  # the optimizer leaves such a value where it is
        self.step(hidden, value)
        self.written[name], self.weight[name] = hidden, weight

    def step(self, hidden: str | None, value: Column) -> None:
        self.steps.append((hidden, value, self.touched))
        self.touched = set()

    def where(self, source: Sequence[str], regex: str, sep: str, wanted: bool) -> None:
        self.early_test = not self.copies and not any(s in self.written for s in source)
        test = self.test(source, regex, sep)
        test = test if wanted else ~test
        if self.early_test:
            self.early.append(test)
        else:
            self.step(None, test)
        self.early_test = False

    # the actions

    def keep(self, source: Sequence[str], regex: str, sep: str = ";") -> None:
        self.where(source, regex, sep, True)

    def drop(self, source: Sequence[str], regex: str, sep: str = ";") -> None:
        self.where(source, regex, sep, False)

    def replace(self, target: str, source: Sequence[str] = (), regex: str = ANYTHING, replacement: str = "$1", sep: str = ";") -> None:
        text = self.joined(source, sep) if source else F.lit("")
        if regex == ANYTHING and replacement in ("$1", "${1}"):
            self.set(target, text, self.weigh(source))
            return
        new = F.lit(replacement) if "$" not in replacement and "\\" not in replacement else F.regexp_replace(text, anchored(regex), replacement)
        self.set(target, F.when(self.test(source, regex, sep), new).otherwise(self.value(target)), 2 * self.weigh(source) + self.weigh([target]))

    def labelmap(self, regex: str, replacement: str = "$1") -> None:
        """Copy every label whose name matches to the name built from its capture groups; empty labels are missing."""
        pattern = re.compile(regex)
        python = re.sub(r"\$(?:\{(\w+)\}|(\d+))", lambda m: rf"\g<{m[1] or m[2]}>", replacement)
        if not self.has_map:
            names = [n for n in self.promoted if isinstance(self.df.schema[n].dataType, T.StringType)]
            found = [(hit.expand(python), self.value(n), n) for n in sorted({*names, *self.written}) if (hit := pattern.fullmatch(n))]
            for target, value, name in found:
                self.set(target, F.coalesce(F.nullif(value, F.lit("")), self.value(target)), 2 * self.weigh([name]) + self.weigh([target]))
            return
        prefix = _PREFIX.fullmatch(regex)
        if prefix and replacement in ("$1", "${1}"):
            held = dict(self.written)
            front = prefix.group(1)
            # what rules have set is copied, or replaced by a copy, as a rule would do it
            targets = dict.fromkeys([*held, *[n[len(front):] for n in held if n.startswith(front) and n != front]])
            for name in targets:
                source = front + name
                copied = self.hidden(held[source]) if source in held else self.read(source, len(self.copies))
                own = self.hidden(held[name]) if name in held else self.read(name, len(self.copies))
                self.set(name, F.coalesce(F.nullif(copied, F.lit("")), own), 3 * self.weigh([name]))
            self.copies.append((prefix.group(1), held))
            self.looked_up = {}
        else:
            self.flush()
            self.df = _labelmap(self.df, regex, replacement)

    def labeldrop(self, names: Sequence[str]) -> None:
        for name in names:
            self.set(name, F.lit(""))

    def flush(self) -> None:
        """Apply what was gathered, and write the labels that rules have set into the map, or into columns of their
        names where there is none."""
        for test in self.early:
            self.df = self.df.where(test)
        together: dict[str, Column] = {}
        for hidden, column, touched in [*self.steps, (None, None, set())]:
            if together and (hidden is None or touched & together.keys()):
                self.df, together = self.df.withColumns(together), {}
            if hidden is not None:
                together[hidden] = column
            elif column is not None:
                self.df = self.df.where(column)
        if not self.has_map:
            made = {n: F.col(h).alias(n) for n, h in self.written.items()}
            order = [made.pop(c) if c in made else F.col(c) for c in self.promoted]  # a promoted label keeps its place
            self.df = self.df.select(*order, *made.values())
        else:
            labels = F.col("labels")
            for prefix, _ in self.copies:
                copied = _copied(labels, prefix)
                self.df = self.df.withColumn("labels", F.when(F.spark_partition_id() >= 0, copied))  # once, not for every label read
            if self.written:
                pair = "struct<key:string,value:string>"
                new = [F.when(F.col(h) != "", F.struct(F.lit(n).alias("key"), F.col(h).alias("value"))).cast(pair) for n, h in self.written.items()]
                old = [F.struct(F.lit(n).alias("key"), F.try_element_at(labels, F.lit(n)).alias("value")).cast(pair) for n in self.written]
                rest = F.array_except(F.map_entries(labels).cast(f"array<{pair}>"), F.array(*old))
                set_ = F.array_except(F.array(*new), F.array(F.lit(None).cast(pair)))
                labels = F.map_from_entries(F.concat(rest, set_))
            self.df = self.df.select(*[labels.alias(c) if c == "labels" else F.col(c) for c in self.df.columns if not c.startswith("_label_")])
        self.written, self.copies, self.weight, self.early, self.steps, self.looked_up = {}, [], {}, [], [], {}
        self.promoted = [c for c in self.df.columns if c != "labels"]


def _copied(labels: Column, prefix: str) -> Column:
    """The map with every non-empty label of the prefix copied to its name without it."""
    hits = F.map_filter(labels, lambda k, v: F.startswith(k, F.lit(prefix)) & (F.length(k) > len(prefix)) & (v != ""))
    renamed = F.transform_keys(hits, lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
    kept = F.map_filter(labels, lambda k, _: F.coalesce(F.try_element_at(labels, F.concat(F.lit(prefix), k)), F.lit("")) == "")
    return F.map_concat(kept, renamed)


def _labelmap(df: DataFrame, regex: str, replacement: str) -> DataFrame:
    """``labelmap`` for name patterns of any form; where two sources give one target, the last by name wins."""
    pattern = anchored(regex)
    entries = F.filter(F.array_sort(F.map_entries("labels")), lambda e: e["key"].rlike(pattern) & (e["value"] != ""))
    renamed = F.transform(entries, lambda e: F.struct(F.regexp_replace(e["key"], pattern, replacement).alias("key"), e["value"].alias("value")))
    names = F.transform(F.col("_renamed"), lambda e: e["key"])
    last = F.filter(F.col("_renamed"), lambda e, i: ~F.array_contains(F.slice(F.col("_names"), i + 2, F.greatest(F.size("_names"), F.lit(1))), e["key"]))
    step = df.withColumn("_renamed", renamed).withColumn("_names", names).withColumn("_copied", F.map_from_entries(last))
    rest = F.map_filter("labels", lambda k, _: ~F.map_contains_key(F.col("_copied"), k))
    return step.withColumn("labels", F.map_concat(rest, F.col("_copied"))).drop("_renamed", "_names", "_copied")


ACTIONS = ("keep", "drop", "replace", "labelmap", "labeldrop")


def relabel(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Apply a list of rules in order. A rule is a dict with ``action`` and that action's arguments."""
    work = Compiler(df)
    for rule in rules:
        args = {k: v for k, v in rule.items() if k != "action"}
        action = rule.get("action", "replace")
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        getattr(work, action)(**args)
    work.flush()
    return work.df


def keep(df: DataFrame, source: Sequence[str], regex: str, sep: str = ";") -> DataFrame:
    """Rows whose joined labels match."""
    return relabel(df, [{"action": "keep", "source": source, "regex": regex, "sep": sep}])


def drop(df: DataFrame, source: Sequence[str], regex: str, sep: str = ";") -> DataFrame:
    """Rows whose joined labels do not match."""
    return relabel(df, [{"action": "drop", "source": source, "regex": regex, "sep": sep}])


def replace(df: DataFrame, target: str, source: Sequence[str] = (), regex: str = ANYTHING,
            replacement: str = "$1", sep: str = ";") -> DataFrame:
    """Set ``target`` from the capture groups of the joined source labels; rows that do not match stay.

    An empty result removes the label. The default pattern takes any text.
    """
    return relabel(df, [{"target": target, "source": source, "regex": regex, "replacement": replacement, "sep": sep}])


def labelmap(df: DataFrame, regex: str, replacement: str = "$1") -> DataFrame:
    """Copy every non-empty label whose name matches to the name built from its capture groups.

    Where two sources give one target, the last by name wins.
    """
    return relabel(df, [{"action": "labelmap", "regex": regex, "replacement": replacement}])


def labeldrop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Remove labels by name."""
    return df.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.isin(list(names))))


def fallback_label(df: DataFrame, target: str, sources: Sequence[str], last: Column | None = None) -> DataFrame:
    """First non-empty source label, else ``last``."""
    work = Compiler(df)
    work.set(target, F.coalesce(*[F.nullif(work.value(s), F.lit("")) for s in sources], last if last is not None else F.lit("")))
    work.flush()
    return work.df


def external_labels(df: DataFrame, constant: dict[str, str]) -> DataFrame:
    """Constant labels on every sample; a label already present keeps its own value."""
    work = Compiler(df)
    for name, value in constant.items():
        known = work.has_map or name in work.promoted
        work.set(name, F.coalesce(F.nullif(work.value(name), F.lit("")), F.lit(value)) if known else F.lit(value))
    work.flush()
    return work.df


def limit_labels(df: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Series with at most ``n`` non-empty labels, and the rejected rest."""
    size = F.size(F.map_filter("labels", lambda _, v: v != ""))
    return df.where(size <= n), df.where(size > n)


def rewrite_port(address: Column, port: Column) -> Column:
    """Host of the address with the given port; unchanged when the port is not a number."""
    pattern = r"^([^:]+)(?::\d+)?;(\d+)$"
    text = F.concat(address, F.lit(";"), port)
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1:$2")).otherwise(address)


def drop_meta(df: DataFrame) -> DataFrame:
    """Remove the discovery labels (leading double underscore) once rewriting is done."""
    return df.withColumn("labels", F.map_filter("labels", lambda k, _: ~F.startswith(k, F.lit("__"))))


def series_key(labels: Column | str, metric: Column | None = None) -> Column:
    """Canonical text of a label set, for grouping and joining; empty labels count as missing."""
    filled = F.map_filter(labels, lambda _, v: v != "")
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(filled))))
    return text if metric is None else F.concat(metric, text)
