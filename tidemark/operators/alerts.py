"""Alert states and the standing alert rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import tseries as TS
from tidemark.operators.labels import label, match_labels, series_key


def alert_states(evals: DataFrame, series: Sequence[str], active: str, hold: float = 300, at: str = "at") -> DataFrame:
    """inactive, pending or firing for each evaluation, with ``since`` = start of the current true run.

    The input has one row per alert series and evaluation time, so a series is as long as the number
    of evaluations and does not grow with the samples behind them.
    """
    w = Window.partitionBy(*series).orderBy(at)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(active), F.lit(False))
    marked = evals.withColumn("_starts", on & ~F.coalesce(F.lag(on).over(w), F.lit(False)))
    since = F.when(on, F.last(F.when(F.col("_starts"), F.col(at)), True).over(run))
    timed = marked.withColumn("since", since).drop("_starts")
    held = micros(F.col(at)) - micros(F.col("since"))
    state = F.when(~on, "inactive").when(held >= int(hold * 1e6), "firing").otherwise("pending")
    return timed.withColumn("state", state)


def fill_evaluations(hits: DataFrame, series: Sequence[str], step: float, at: str = "at") -> DataFrame:
    """Turn "rows only where the condition holds" into rows with ``active``: each hit, and the first
    evaluation after it where the series is not a hit any more."""
    tick = int(step * 1e6)
    here = F.struct(F.col(at).alias("_t"), F.lit(True).alias("active"), F.col("value").alias("_v"))
    later = F.timestamp_micros(micros(F.col(at)) + tick).cast("timestamp_ntz")
    after = F.struct(later.alias("_t"), F.lit(False).alias("active"), F.lit(None).cast("double").alias("_v"))
    both = hits.select(*series, F.inline(F.array(here, after))).withColumnRenamed("_t", at)
    return both.groupBy(*series, at).agg(F.max("active").alias("active"), F.max("_v").alias("value"))


def render_alert(df: DataFrame, alert: str, severity: str, summary: str, description: str, value: str = "value") -> DataFrame:
    """Alert name, severity and texts. ``{label}`` is replaced by a column, ``{value:%.2f}`` by the value."""
    return df.withColumns(
        {
            "alert": F.lit(alert),
            "severity": F.lit(severity),
            "summary": _template(df, summary, value),
            "description": _template(df, description, value),
        }
    )


def _template(df: DataFrame, text: str, value: str) -> Column:
    parts: list[Column] = []
    rest = text
    while "{" in rest:
        plain, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts.append(F.lit(plain))
        if name.startswith("value:"):
            parts.append(F.format_string(name[len("value:"):], F.col(value)))
        elif name in df.columns:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        else:
            parts.append(F.lit(""))
    return F.concat(*parts, F.lit(rest))


@dataclass(frozen=True)
class Rule:
    """A standing rule: ``condition(samples, step)`` gives the true series as (labels..., at, value); ``labels``: those its texts and panels use."""

    alert: str
    labels: tuple[str, ...]
    severity: str
    summary: str
    description: str
    condition: Callable[[DataFrame, float], DataFrame] = field(repr=False)
    hold: float = 300


#: Labels that rules group by, match on or print; taken out of the label map where they are not columns already.
LIFTED = ("namespace", "pod", "container", "deployment", "node", "instance", "job", "le", "condition", "status", "mode")


def lift_labels(samples: DataFrame, names: Sequence[str] = LIFTED) -> DataFrame:
    """Samples with the named labels as columns and all further labels of a map in one key ``_series``.

    Together the columns beside metric, ts and value are the full label set of a series.
    """
    if "labels" not in samples.columns:
        return samples
    missing = [n for n in names if n not in samples.columns]
    rest = F.map_filter("labels", lambda k, _: ~k.isin(*missing)) if missing else F.col("labels")
    return samples.withColumns({**{n: label(samples, n) for n in missing}, "_series": series_key(rest)}).drop("labels")


def identity(samples: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """The label columns that name a series."""
    return [c for c in samples.columns if c not in ("metric", "labels", "ts", "value", *without)]


def _metric(samples: DataFrame, name: str, **matchers) -> DataFrame:
    return match_labels(samples.where(F.col("metric") == name), **matchers)


def _now(s: DataFrame, step: float, name: str, **matchers) -> DataFrame:
    return TS.instant_grid(_metric(s, name, **matchers), identity(s), step)


def _rate(s: DataFrame, step: float, name: str, **matchers) -> DataFrame:
    return TS.rate_grid(_metric(s, name, **matchers), identity(s), step, 300)


def _sum_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "at").agg(F.sum("value").alias("value"))


def _crash_looping(s: DataFrame, step: float) -> DataFrame:
    grown = TS.increase_grid(_metric(s, "kube_pod_container_status_restarts_total"), identity(s), step, 3600)
    return TS.threshold_filter(grown, ">", 3)


def _pod_not_ready(s: DataFrame, step: float) -> DataFrame:
    return TS.threshold_filter(_now(s, step, "kube_pod_status_ready", eq={"condition": "false"}), "==", 1)


def _container_cpu(s: DataFrame, step: float) -> DataFrame:
    cpu = _rate(s, step, "container_cpu_usage_seconds_total", ne={"container": ""})
    return TS.threshold_filter(_sum_by(cpu, "namespace", "pod"), ">", 0.8)


def _container_memory(s: DataFrame, step: float) -> DataFrame:
    used = _now(s, step, "container_memory_usage_bytes", ne={"container": ""})
    limit = _now(s, step, "container_spec_memory_limit_bytes", ne={"container": ""}).where("value > 0")
    on = ["namespace", "pod"]
    return TS.threshold_filter(TS.vector_div(_sum_by(used, *on), _sum_by(limit, *on), [*on, "at"]), ">", 0.9)


def _replicas(s: DataFrame, step: float) -> DataFrame:
    want, have = _now(s, step, "kube_deployment_spec_replicas"), _now(s, step, "kube_deployment_status_replicas_available")
    return TS.vector_ne(want, have, [*identity(s), "at"])


def _error_rate(s: DataFrame, step: float) -> DataFrame:
    per = _rate(s, step, "http_requests_total", re={"status": "5.."})
    return TS.threshold_filter(_sum_by(per, "namespace"), ">", 0.05)


def _response_time(s: DataFrame, step: float) -> DataFrame:
    grown = _rate(s, step, "http_request_duration_seconds_bucket").withColumnRenamed("value", "c")
    return TS.threshold_filter(TS.histogram_quantile(grown, 0.99, [*identity(s, ["le"]), "at"]), ">", 1)


def _node_cpu(s: DataFrame, step: float) -> DataFrame:
    idle = _rate(s, step, "node_cpu_seconds_total", eq={"mode": "idle"})
    busy = idle.groupBy("instance", "at").agg((F.lit(100.0) - F.avg("value") * 100).alias("value"))
    return TS.threshold_filter(busy, ">", 80)


def _node_memory(s: DataFrame, step: float) -> DataFrame:
    total, free = _now(s, step, "node_memory_MemTotal_bytes"), _now(s, step, "node_memory_MemAvailable_bytes")
    return TS.threshold_filter(TS.used_percent(total, free, [*identity(s), "at"]), ">", 85)


def _disk_pressure(s: DataFrame, step: float) -> DataFrame:
    return TS.threshold_filter(_now(s, step, "kube_node_status_condition", eq={"condition": "DiskPressure", "status": "true"}), "==", 1)


def _reload_failed(s: DataFrame, step: float) -> DataFrame:
    return TS.threshold_filter(_now(s, step, "prometheus_config_last_reload_successful"), "==", 0)


def _restarts(s: DataFrame, step: float) -> DataFrame:
    started = _metric(s, "process_start_time_seconds", eq={"job": "prometheus"})
    return TS.threshold_filter(TS.increase_grid(started, identity(s), step, 900, kind="changes"), ">", 2)


def _target_down(s: DataFrame, step: float) -> DataFrame:
    return TS.threshold_filter(_now(s, step, "up", ne={"job": "prometheus"}), "==", 0)


# fixed values: rule names, metric names, limits, severities and texts
RULES = {
    r.alert: r
    for r in (
        Rule("PodCrashLooping", ("namespace", "pod", "container"), "critical", "Pod {pod} is crash looping",
             "Pod has restarted more than 3 times in the past hour.\nCurrent restart count (1h): {value:%.0f}\n", _crash_looping),
        Rule("PodNotReady", ("namespace", "pod"), "warning", "Pod {pod} not ready",
             "Pod has been not ready for more than 5 minutes.\n", _pod_not_ready),
        Rule("ContainerHighCPU", ("namespace", "pod"), "warning", "High CPU usage on {pod}",
             "Pod is using more than 0.8 CPU cores.\n", _container_cpu),
        Rule("ContainerHighMemory", ("namespace", "pod"), "warning", "High memory usage on {pod}",
             "Pod is using more than 90% of its memory limit.\n", _container_memory),
        Rule("DeploymentReplicasMismatch", ("namespace", "deployment"), "warning", "Deployment replica mismatch",
             "Deployment has unavailable replicas.\n", _replicas),
        Rule("HighErrorRate", ("namespace",), "critical", "High application error rate",
             "High HTTP 5xx error rate detected.\nCurrent value: {value:%.2f}\n", _error_rate),
        Rule("HighResponseTime", ("namespace", "pod"), "warning", "High response latency",
             "99th percentile latency is above 1 second.\nCurrent latency: {value:%.2f} seconds.\n", _response_time),
        Rule("NodeHighCPU", ("instance",), "warning", "Node {instance} high CPU", "CPU usage is above 80%.\n", _node_cpu),
        Rule("NodeHighMemory", ("instance",), "warning", "Node {instance} high memory", "Memory usage is above 85%.\n", _node_memory),
        Rule("NodeDiskPressure", ("node",), "critical", "Node {node} disk pressure", "Node is under disk pressure.\n", _disk_pressure),
        Rule("PrometheusConfigReloadFailed", ("instance",), "warning", "Prometheus configuration reload failed",
             "Prometheus failed to reload its configuration.\n", _reload_failed),
        Rule("PrometheusTooManyRestarts", ("instance",), "warning", "Prometheus restarting too frequently",
             "Prometheus has restarted multiple times in the last 15 minutes.\n", _restarts),
        Rule("PrometheusTargetDown", ("job", "instance"), "warning", "Prometheus scrape target down",
             "One or more scrape targets are unreachable.\n", _target_down),
    )
}


def evaluate_rule(rule: Rule, samples: DataFrame, step: float = 30) -> DataFrame:
    """State per true evaluation of a rule, with its texts: (labels..., at, value, since, state, ...).

    A series is named by all its labels, promoted or in a ``labels`` map; the labels of an alert are those
    of the rule's result: all of them, or the ones it groups by.
    """
    hits = rule.condition(lift_labels(samples), step)
    series = [c for c in hits.columns if c not in ("at", "value")]
    states = alert_states(fill_evaluations(hits, series, step), series, "active", rule.hold).where("active").drop("active")
    return render_alert(states, rule.alert, rule.severity, rule.summary, rule.description)
