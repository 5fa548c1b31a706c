"""Restoring placeholders in chunked responses, where one may be split between chunks.

Of what has come so far, the longest end that could still grow into a placeholder is held back.  Placeholders begin with
"<" and have no other one, as the masking operators make them, so only what follows the last "<" can be held back.

A chunk with a finish_reason ends its choice: all fields of the choice pass on what they hold back.  The batch form needs
only the last few characters before each chunk; the stateful form keeps what is held back, by request.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.restore import as_maps, replace_placeholders
from ..sources.mappings import DEFAULT_TTL

def restore_chunks(chunks: DataFrame, mapping: DataFrame | None = None, *, longest: int = 64) -> DataFrame:
    """chunks (request_id, choice_index, field, seq, delta, finish_reason) with `emitted`, the text to pass on.

    mapping: rows (request_id, placeholder, original); None if chunks have a map `mapping`, on one chunk of each choice
    at least.  A chunk with a finish_reason passes on all that its choice held back, in each of the choice's fields: a row
    whose field is null (a finish without text) comes back as a row for each, and where a field has no row of its own one
    comes back if it has something to pass on.  The last chunk of a field does the same.  longest: characters of a
    placeholder at most; a longer one is an error.

    Windows by field: a row sees the ends of the chunks before it, at most longest characters, never the whole text; and
    mappings come to the rows when the windows are done.
    """
    choice, key = ["request_id", "choice_index"], ["request_id", "choice_index", "field"]
    slim = chunks if mapping is None else chunks.repartition(F.col("request_id"))
    # a chunk that finishes its choice becomes a row for each field of the choice; all windows share this one's shuffle
    fields = F.array_compact(F.array_distinct(F.concat(F.array("field"), F.collect_set("field").over(Window.partitionBy(*choice)))))
    ended = F.when(F.size("fields_") > 0, F.col("fields_")).otherwise(F.array(F.lit("content")))
    rows = slim.withColumn("fields_", fields).withColumn("field_", F.explode(F.when(F.col("finish_reason").isNotNull(), ended).otherwise(F.array("field"))))
    own = F.col("field").isNull() | (F.col("field") == F.col("field_"))
    rows = rows.withColumn("own_", own).withColumn("delta_", F.when(F.col("own_"), F.coalesce("delta", F.lit(""))).otherwise("")).withColumn("field", F.col("field_"))
    rows = rows.withColumn("n_own_", F.count_if("own_").over(Window.partitionBy(*key, "seq")))
    both = rows.where(F.col("own_") | (F.col("n_own_") == 0)).drop("fields_", "field_", "n_own_")

    w = Window.partitionBy(*key).orderBy("seq", F.col("own_").desc())
    ends = F.col("finish_reason").isNotNull() | F.lead("seq").over(w).isNull()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumns({"ends_": ends, "part_": F.coalesce(F.count_if(F.col("finish_reason").isNotNull()).over(before), F.lit(0)), "n_": F.sum(F.length("delta_")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    near = Window.partitionBy(*key, "part_").orderBy("n_").rangeBetween(-longest, 0)  # chunks that end so near before
    tailed = counted.withColumn("tail_", F.array_join(F.collect_list(F.expr(f"right(delta_, {longest})")).over(near), ""))
    tailed = tailed.withColumn("last_", F.when(~F.lag("ends_").over(w), F.lag("tail_").over(w)))

    if mapping is None:
        known = tailed.withColumn("map_", F.first("mapping", ignorenulls=True).over(Window.partitionBy(*choice)))
    else:
        known = tailed.join(as_maps(mapping, "request_id").withColumnRenamed("mapping", "map_"), "request_id", "left")
    names = F.map_keys("map_")
    held = lambda text: F.when(F.contains(text, F.lit("<")), held_back(text, names)).otherwise(0)
    too_long = F.coalesce(F.exists(names, lambda p: F.length(p) > longest), F.lit(False))
    keep = F.when(too_long, F.raise_error(F.lit(f"a placeholder is longer than {longest} characters")).cast("int")).when(F.col("ends_"), F.lit(0)).otherwise(held(F.col("tail_")))
    out = known.withColumns({"keep_": F.coalesce(keep, F.lit(0)), "had_": F.coalesce(held(F.col("last_")), F.lit(0))})
    text = F.concat(F.when(F.col("had_") > 0, F.expr("right(last_, had_)")).otherwise(""), F.col("delta_"))
    out = out.withColumn("text_", text).withColumn("new_", F.substring("text_", F.lit(1), F.length("text_") - F.col("keep_")))
    out = out.withColumn("emitted", F.coalesce(replace_placeholders(F.col("new_"), F.col("map_")), F.col("new_")))
    return out.where(F.col("own_") | (F.col("emitted") != "")).select(*chunks.columns, "emitted")


def held_back(text: Column, placeholders: Column) -> Column:
    """Length of the longest end of text that is a true beginning of a placeholder."""
    end = F.when(F.contains(text, F.lit("<")), F.concat(F.lit("<"), F.substring_index(text, "<", -1)))
    grows = F.exists(placeholders, lambda p: F.startswith(p, end) & (F.length(p) > F.length(end)))
    return F.when(F.coalesce(grows, F.lit(False)), F.length(end)).otherwise(0)


def passed_on(pending: str, delta: str, mapping: dict[str, str], ends: bool = False) -> tuple[str, str]:
    """(text to pass on, text to hold back) once delta has followed what was held back."""
    text = pending + delta
    at = -1 if ends else text.rfind("<")
    if at < 0 or not any(len(p) > len(text) - at and p.startswith(text[at:]) for p in mapping):
        at = len(text)
    out = text[:at]
    for p in sorted(mapping, key=lambda p: (-len(p), p)) if "<" in out else ():
        out = out.replace(p, mapping[p])
    return out, text[at:]


def restore_stream(chunks: DataFrame, *, idle: str | None = "10 minutes", ttl_seconds: int = DEFAULT_TTL) -> DataFrame:
    """Streaming form.  chunks: request_id, choice_index, field (null: a finish without text), seq, delta, finish_reason,
    mapping (map; the request's first chunk must have it, later ones may).

    State is a request's mapping and what its fields hold back.  A finish passes on what its choice's fields hold back;
    a mapping older than ttl_seconds (by the clock) is forgotten, and what comes then passes as it is.  State goes when
    the request falls idle, and then what is held back is passed on.  idle=None sets no timeout: needed with the
    availableNow trigger, which otherwise never ends.

    Chunks of a field must come in order: those of one micro-batch are sorted by seq, but a chunk that comes in a later
    batch than its successor is passed on behind it.  A source that is partitioned by request keeps the order.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    columns = ["request_id", "choice_index", "field", "seq", "emitted"]
    ttl = ttl_seconds if ttl_seconds > 0 else DEFAULT_TTL

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, born, choices, fields, texts, last = ([], [], 0.0, [], [], [], -1) if not state.exists else state.get
        mapping, held = dict(zip(names, values)), dict(zip(zip(choices, fields), texts))
        if state.hasTimedOut:
            state.remove()
            rows = [(*key, c, f, last + 1, passed_on(t, "", mapping, True)[0]) for (c, f), t in held.items() if t]
            if rows:
                yield pd.DataFrame(rows, columns=columns)
            return
        now, rows = time.time(), []
        if mapping and now - born > ttl:
            mapping = {}
        for x in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if not born and x.mapping is not None and len(x.mapping):
                mapping, born = dict(x.mapping), now
            choice, last = int(x.choice_index), max(last, int(x.seq))
            out: dict[str, str] = {}
            if isinstance(x.field, str):
                out[x.field], held[choice, x.field] = passed_on(held.get((choice, x.field), ""), x.delta if isinstance(x.delta, str) else "", mapping)
            if isinstance(x.finish_reason, str):
                for c, f in [k for k in held if k[0] == choice]:
                    rest = passed_on(held.pop((c, f)), "", mapping, True)[0]
                    if rest:
                        out[f] = out.get(f, "") + rest
            rows += [(*key, choice, f, int(x.seq), text) for f, text in out.items()]
        held = {k: t for k, t in held.items() if t}
        state.update((list(mapping), list(mapping.values()), born, [c for c, _ in held], [f for _, f in held], list(held.values()), last))
        if idle:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(rows, columns=columns)

    schema = "request_id string, choice_index int, field string, seq long, emitted string"
    kept = "names array<string>, values array<string>, born double, choices array<int>, fields array<string>, texts array<string>, last long"
    return chunks.groupBy("request_id").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def stream_outcomes(streams: DataFrame, *, on_failure: str = "fail_open") -> DataFrame:
    """(request_id, result, action, done, delete_mapping) of each streamed response.

    streams: request_id (null: none known), has_mapping, load_failed, upstream_failed, changed (a chunk was restored).
    A stream that is looked at is marked as done and its mapping deleted, also when the upstream breaks off (then it has
    no result); where the mapping can't be loaded the failure mode says whether chunks pass or the response is refused.
    """
    from ..operators.mask import failure_mode

    known = F.col("request_id").isNotNull()
    result = (
        F.when(~known, "skipped").when(F.col("load_failed"), "error").when(~F.col("has_mapping"), "no_mapping")
        .when(F.col("upstream_failed"), F.lit(None).cast("string")).when(F.col("changed"), "restored").otherwise("no_placeholders")
    )
    refused = known & F.col("load_failed") & F.lit(failure_mode(on_failure) == "fail_closed")
    looked = known & ~F.col("load_failed") & F.col("has_mapping")
    action = F.when(refused, "reject").when(looked, "restore").otherwise("pass")
    done = known & ~F.col("load_failed")
    return streams.select("request_id", result.alias("result"), action.alias("action"), F.coalesce(done, F.lit(False)).alias("done"), F.coalesce(looked, F.lit(False)).alias("delete_mapping"))
