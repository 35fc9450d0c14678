"""Registry checks: row rules, supersede chains, snapshot differences, observed codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.schema import STREAMS
from tapelake.session import ensure_checkpoint_dir

# Fixed values.
KINDS = ("defect", "shape")
STATUSES = ("pending", "active", "rejected", "superseded")
LIVE = ("active", "pending")
ACTIONS = ("patch", "gap", "none")
REQUIRED = ("id", "code", "kind", "status", "created_at", "evidence", "evidence_sha256", "read_layer_action")
IMMUTABLE = ("code", "kind", "created_at", "evidence", "evidence_sha256", "decision_ref", "decision_sha256", "note",
             "read_layer_action")
TRANSITIONS = (("pending", "active"), ("active", "superseded"), ("pending", "rejected"))
DEFECT_CODES = ("time_6digit", "seq_empty", "seq_sparse_dup", "rescue_partial", "enum_drift", "int32_overflow",
                "nul_sentinel_sh", "quote_only", "empty_file", "no_trailing_comma", "stream_symbol_mismatch",
                "leading_zero_time", "duplicate_open_frame")

_DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_HEX64 = "^[0-9a-f]{64}$"


def _exact_date(c: Column) -> Column:
    return F.coalesce(c.rlike(_DAY) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def _row_rules(codes: Iterable[str], handled: Iterable[str] | None) -> dict[str, Column]:
    """Rule name to the condition under which a complete row breaks it."""
    c = F.col
    days = F.coalesce(c("days"), F.array().cast("array<string>"))
    live = c("status").isin(*LIVE)
    rules = {
        "kind, status or action outside its values":
            ~(c("kind").isin(*KINDS) & c("status").isin(*STATUSES) & c("read_layer_action").isin(*ACTIONS)),
        "unknown stream": c("stream").isNotNull() & ~c("stream").isin(*STREAMS),
        "unknown code": live & ~c("code").isin(*codes),
        "superseded and superseded_by go together": (c("status") == "superseded") != c("superseded_by").isNotNull(),
        "created_at is no exact date": ~_exact_date(c("created_at")),
        "days hold no exact date": F.exists(days, lambda d: ~_exact_date(d)),
        "patch and gap need days": c("read_layer_action").isin("patch", "gap") & (F.size(days) == 0),
        "an active shape needs decision_ref":
            (c("kind") == "shape") & (c("status") == "active") & (F.coalesce(c("decision_ref"), F.lit("")) == ""),
        "evidence_sha256 is no digest": ~c("evidence_sha256").rlike(_HEX64),
        "decision_sha256 is no digest": c("decision_sha256").isNotNull() & ~c("decision_sha256").rlike(_HEX64),
    }
    if handled is not None:
        rules |= {
            "patch code without handler": (c("read_layer_action") == "patch") & ~c("code").isin(*handled),
            "decision_ref and decision_sha256 go together":
                c("decision_ref").isNotNull() != c("decision_sha256").isNotNull(),
            "decision_ref repeats evidence": live & (c("decision_ref") == c("evidence")),
        }
    return rules


def rule_problems(rows: DataFrame, codes: Iterable[str] = DEFECT_CODES,
                  handled: Iterable[str] | None = None) -> DataFrame:
    """(id, problem) for every broken row rule and repeated id; ``handled`` adds the stricter review rules."""
    missing = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in REQUIRED]
    incomplete = F.array_compact(F.array(*missing))
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in _row_rules(codes, handled).items()]))
    problems = F.when(F.size(incomplete) > 0, incomplete).otherwise(broken)
    by_row = rows.select("id", F.explode(problems).alias("problem"))
    repeated = rows.filter("id is not null").groupBy("id").count().filter("count > 1")
    return by_row.unionByName(repeated.select("id", F.lit("repeated id").alias("problem")))


def chain_problems(rows: DataFrame) -> DataFrame:
    """(id, problem) for supersede chains that break, circle, or do not end in a live entry.

    Pointers are doubled per round, so chains of length n take log2(n) joins, whatever the number of entries; entries that arrived
    leave the rounds, and so do pointers of entries that no open one points at any more. Rounds are cut by checkpoints. Of entries with the same id the least by status and pointer counts; that
    ids are repeated is a rule of its own.
    """
    spark = rows.sparkSession
    nodes = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("status", "superseded_by")).alias("e")).select("id", "e.*")
    target = nodes.select(F.col("id").alias("superseded_by"), F.col("status").alias("target_status"))
    hop_broken = F.col("superseded_by").isNotNull() & F.coalesce(F.col("target_status") == "rejected", F.lit(True))
    end = F.when(hop_broken, "supersede chain is broken") \
        .when(F.col("superseded_by").isNull() & ~F.col("status").isin(*LIVE), "supersede chain ends in no live entry") \
        .when(F.col("superseded_by").isNull(), "ok")
    # entries without a pointer have nothing to look up; met in one join they would be its one hot key
    steps = nodes.filter("superseded_by is not null").join(target, "superseded_by", "left") \
        .unionByName(nodes.filter("superseded_by is null").withColumn("target_status", F.lit(None).cast("string"))) \
        .select("id", "superseded_by", end.alias("end"))
    chained = steps.filter("superseded_by is not null")
    if chained.isEmpty():
        return chained.select("id", F.lit("").alias("problem")).limit(0)

    ensure_checkpoint_dir(spark)
    arrived = chained.filter("end is not null").select("id", "end")
    hops = steps.select(F.col("id").alias("at"), F.col("superseded_by").alias("next"), "end").checkpoint()
    open_rows = chained.filter("end is null").select("id", F.col("superseded_by").alias("at")).checkpoint()
    places = open_rows.select("at").distinct().checkpoint()
    left = places.count()
    while left:
        moved = open_rows.join(hops, "at", "left").select("id", F.col("next").alias("at"), "end").checkpoint()
        arrived = arrived.unionByName(moved.filter("end is not null").select("id", "end"))
        open_rows = moved.filter("end is null").select("id", "at")
        # Every entry is a row, so rows stand at places where rows stood before: as many places as before means the same ones, from
        # which hops lead to each other and nowhere else.
        before, places = left, open_rows.select("at").distinct().checkpoint()
        left = places.count()
        if left == before:
            arrived = arrived.unionByName(open_rows.select("id", F.lit("supersede chain circles").alias("end")))
            break
        # for the same reason hops from other places are not needed again
        hops = hops.join(places, "at", "left_semi").checkpoint()
        # hops that arrived stay as they are: their pointers, null or far from unique, take no part in the join
        doubled = hops.filter("end is null").alias("a").join(hops.alias("b"), F.col("a.next") == F.col("b.at"), "left") \
            .select(F.col("a.at"), F.col("b.next"), F.col("b.end"))
        hops = hops.filter("end is not null").unionByName(doubled).checkpoint()
    return arrived.filter("end <> 'ok'").select("id", F.col("end").alias("problem"))


def snapshot_problems(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, problem) where the new registry snapshot does more than append to the old one."""
    c = F.col
    names = [x for x in old.columns if x != "id"]
    both = old.filter("id is not null").select("id", F.col("id").alias("old_id"), F.struct(*names).alias("old")).join(
        new.filter("id is not null").select("id", F.col("id").alias("new_id"), F.struct(*names).alias("new")), "id", "full_outer")
    no_days = F.array().cast(old.schema["days"].dataType)
    old_days, new_days = F.coalesce(c("old.days"), no_days), F.coalesce(c("new.days"), no_days)
    before, after = F.coalesce(c("old.status"), F.lit("active")), F.coalesce(c("new.status"), F.lit("active"))
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((before == a) & (after == b))
    changes = [F.when(c(f"old.{k}").isNotNull() & ~c(f"old.{k}").eqNullSafe(c(f"new.{k}")), F.lit(f"{k} changed"))
               for k in IMMUTABLE]
    changes += [
        F.when(~c("old.stream").eqNullSafe(c("new.stream")), F.lit("stream scope changed")),
        F.when(c("old.days").isNull() & c("new.days").isNotNull(), F.lit("structural entry narrowed to days")),
        F.when(F.size(F.array_except(old_days, new_days)) > 0, F.lit("days removed")),
        F.when((before != after) & ~allowed, F.lit("status change not allowed")),
        F.when(c("old.superseded_by").isNotNull() & ~c("old.superseded_by").eqNullSafe(c("new.superseded_by")),
               F.lit("superseded_by changed")),
    ]
    problems = F.when(c("new_id").isNull(), F.array(F.lit("entry deleted"))) \
        .when(c("old_id").isNull(), F.array_compact(F.array(F.when(after != "pending", F.lit("new entry not pending"))))) \
        .otherwise(F.array_compact(F.array(*changes)))
    return both.select("id", F.explode(problems).alias("problem"))


def registered_codes(registry: DataFrame) -> DataFrame:
    """Codes of live entries; an observation may precede its ruling, so pending ones count."""
    return registry.filter(F.col("status").isin(*LIVE)).select("code").distinct()


def unregistered_codes(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """Observed rows whose code no live entry registers."""
    return observed.join(registered_codes(registry), "code", "left_anti")


def code_set_difference(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """(code, side) for codes that only the declared list, or only the live registry, has."""
    codes, live = declared.select("code").distinct(), registered_codes(registry)
    return codes.join(live, "code", "left_anti").withColumn("side", F.lit("declared only")).unionByName(
        live.join(codes, "code", "left_anti").withColumn("side", F.lit("registry only")))


# The columns every observation batch must state.
BATCH_FIELDS = ("file", "sha256", "scanner", "scanner_sha256", "input", "input_sha256", "scanned_at")


def batch_problems(batches: DataFrame, files: DataFrame, registry: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(file, problem) for observation batches against the observation files.

    ``batches`` has the fixed batch columns, ``files`` has (file, sha256, codes). ``old`` is an earlier batch list that
    must survive unchanged; the stricter scanner rule only judges batches it does not hold.
    """
    c = F.col
    missing = [F.when(c(k).isNull(), F.lit(f"missing {k}")) for k in BATCH_FIELDS]
    known = batches if old is None else batches.join(
        old.select("file", F.lit(True).alias("known")).distinct(), "file", "left")
    is_new = F.lit(True) if old is None else c("known").isNull()
    external = c("scanner").startswith("external:")
    judged = known.join(files.select("file", c("sha256").alias("found")), "file", "left")
    rules = F.array_compact(F.array(
        *missing,
        F.when(~c("file").rlike(r"^[A-Za-z0-9_.-]+\.toml$"), F.lit("file is no plain name")),
        F.when(~external & ~c("scanner").startswith("tools/"), F.lit("scanner is neither a tool nor external")),
        F.when(external & is_new & (~c("scanner_sha256").rlike("^.{64}$") | c("scanner_sha256").rlike("^0{64}$")),
               F.lit("external scanner without digest")),
        F.when(c("found").isNull(), F.lit("file missing")).when(c("found") != c("sha256"), F.lit("file altered"))))
    out = judged.select("file", F.explode(rules).alias("problem"))
    unlisted = files.join(batches.select("file"), "file", "left_anti")
    out = out.unionByName(unlisted.select("file", F.lit("file in no batch").alias("problem")))
    codes = files.join(batches.select("file").distinct(), "file", "left_semi") \
        .select("file", F.explode("codes").alias("code"))
    unknown = unregistered_codes(codes, registry)
    out = out.unionByName(unknown.select("file", F.concat(F.lit("unregistered code "), c("code")).alias("problem")))
    if old is not None:
        same = batches.select(*BATCH_FIELDS).intersect(old.select(*BATCH_FIELDS))
        changed = old.join(same.select("file"), "file", "left_anti")
        out = out.unionByName(changed.select("file", F.lit("earlier batch changed or removed").alias("problem")))
    return out
