"""The registered queries: each operator over the driver's tables, or over rows made from their keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import bodies as B
from ..operators import mask as M
from ..operators import metrics, ner, routing
from ..operators import restore as R
from ..operators import spans as S
from ..operators import targets as T
from ..operators.detect import detect, detected_rows, spread
from ..sources import mappings
from ..streaming import replacer
from .synthetic import N10, N11, N12, TURN_TEXT, customers, table, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate data; one of this machine only if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _found(name: str, source, entities=None, key="doc_id", **how) -> None:
    QUERIES[name] = lambda spark, sf_dir: detected_rows(detect(source(spark, sf_dir), entities=entities, **how), [key])


_found("detect_card", _documents, ["CREDIT_CARD"])
_found("detect_email", _documents, ["EMAIL_ADDRESS"], context=False)
for _name, _entity in (("phone", "PHONE_NUMBER"), ("inn", "RU_INN"), ("snils", "RU_SNILS"), ("passport", "RU_PASSPORT")):
    _found(f"detect_{_name}", lambda s, d, n=_name: customers(s, d, n), [_entity], key="c_custkey")
_found("detect_address", lambda s, d: customers(s, d, "address"), ["RU_ADDRESS"], key="c_custkey", context=False)
_found("detect_inn_strict", lambda s, d: customers(s, d, "inn_strict"), ["RU_INN"], key="c_custkey", detect_bare_inn=False)
_found("detect_threshold", lambda s, d: customers(s, d, "inn_strict"), ["RU_INN"], key="c_custkey", detect_bare_inn=False, score_threshold=0.2)
_found("detect_all", _documents, context=False)
_found("detect_allow_list", _documents, ["CREDIT_CARD", "EMAIL_ADDRESS"], context=False)


def _valid(name: str, number: str, check) -> None:
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", F.expr(number).alias("number")).select("c_custkey", "number", check(F.col("number")).alias("valid"))


_valid("validate_inn10", N10, checks.inn10)
_valid("validate_inn12", N12, checks.inn12)
_valid("validate_snils", N11, checks.snils)
_valid("validate_luhn", f"{N10} || substr({N11}, 1, 6)", checks.card)

#: Spans over a text of twenty characters, made from an order's key: some overlap, some are impossible.
SPAN_ROWS = "array(struct('PERSON', cast(o_orderkey % 5 as int), cast(o_orderkey % 5 + 4 as int), 0.7D, ''), struct('phone number', cast(o_orderkey % 7 as int), cast(o_orderkey % 7 + 6 as int), 0.85D, ''), struct('RU_INN', cast(o_orderkey % 11 - 1 as int), cast(o_orderkey % 11 + 3 as int), 0.4D, ''), struct('__', cast(o_orderkey % 13 + 6 as int), cast(o_orderkey % 13 + 9 as int), 1.0D, ''))"


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lit("abcdefghijklmnopqrst").alias("text"), F.expr(SPAN_ROWS).cast(S.SPANS).alias("raw"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.explode("spans").alias("s")).select("o_orderkey", F.col("s.entity_type").alias("entity_type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query
def spans_dedup(spark, sf_dir):
    return _flat(_span_rows(spark, sf_dir).withColumn("spans", S.resolve_by_score(F.col("raw"))))


@query
def spans_normalize(spark, sf_dir):
    return _flat(_span_rows(spark, sf_dir).withColumn("spans", S.normalise(F.col("raw"), F.col("text"))))


@query
def entity_type_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.normalise_type(F.concat(F.lit("__"), "p_type", F.lit("-"), F.coalesce("p_brand", F.lit("")))).alias("entity_type"), S.normalise_type(F.lit("_#_")).alias("empty_type"))


@query
def entity_counts(spark, sf_dir):
    return metrics.counts(detected_rows(detect(_documents(spark, sf_dir), context=False), ["doc_id"]), "entity_type")


@query
def entity_counts_by_lang(spark, sf_dir):
    return metrics.counts(detected_rows(detect(_documents(spark, sf_dir), context=False), ["doc_id", "lang"]), "lang", "entity_type")


def _turn_spans(spark, sf_dir):
    return detect(spread(turns(spark, sf_dir)), entities=["PHONE_NUMBER", "EMAIL_ADDRESS"])


def _masked_turns(spark, sf_dir):
    """Turns with masked_text and the placeholders of each, numbered by conversation."""
    return M.mask_requests(_turn_spans(spark, sf_dir), "conv_id", "turn")


def _mapping(masked: DataFrame) -> DataFrame:
    return masked.select("conv_id", F.explode_outer("mapping").alias("m")).where(F.col("m").isNotNull()).select("conv_id", "m.*")


@query
def placeholder_numbering(spark, sf_dir):
    rows = M.number_placeholders(_turn_spans(spark, sf_dir), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.col("start").cast("long").alias("start"), "entity_type", "placeholder", "text")


@query
def mask_documents(spark, sf_dir):
    return M.mask_rows(detect(_documents(spark, sf_dir), context=False)).select("doc_id", "masked_text")


@query
def mask_conversations(spark, sf_dir):
    return _masked_turns(spark, sf_dir).select("conv_id", "turn", "masked_text")


@query
def mapping_rows(spark, sf_dir):
    return _mapping(_masked_turns(spark, sf_dir))


@query
def mapping_size_histogram(spark, sf_dir):
    sizes = _mapping(_masked_turns(spark, sf_dir)).groupBy("conv_id").agg(F.count(F.lit(1)).cast("double").alias("size"))
    return metrics.histogram(sizes, "size", metrics.SIZE_BUCKETS)


@query
def block_policy(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")  # own texts; the phone and the e-mail only in each third conversation
    some = detect(said.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.expr(TURN_TEXT)).otherwise(F.coalesce("text", F.lit(""))).alias("text")))
    return M.block_verdicts(some, "conv_id").select("conv_id", "blocked", F.array_join("entities", ",").alias("entities"))


@query
def block_errors(spark, sf_dir):
    verdicts = M.block_verdicts(_turn_spans(spark, sf_dir), "conv_id").where("blocked").select("conv_id", M.blocked_error(F.col("entities")).alias("e"))
    return verdicts.select("conv_id", F.col("e.status").cast("long").alias("status"), "e.type", "e.code", F.array_join("e.entities", ",").alias("entities"))


def _fields(spark, sf_dir):
    """Fields of requests made from orders: request o_custkey, a failing field here and there."""
    o = table(spark, sf_dir, "orders")
    error = F.when(F.col("o_orderkey") % 17 == 0, "failed").when(F.col("o_orderkey") % 101 == 0, "overloaded")
    return o.select(F.col("o_custkey").alias("request_id"), F.when(F.col("o_custkey") % 19 != 0, F.col("o_orderkey")).alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("n_spans"), error.alias("error"), (F.col("o_custkey") % 23 == 0).alias("unsaved")).withColumn("error", F.when(F.col("ord").isNotNull(), F.col("error")))


@query
def pre_call_outcomes(spark, sf_dir):
    return metrics.counts(M.request_outcomes(_fields(spark, sf_dir), "request_id", "ord", save_failed="unsaved"), "result")


@query
def fail_mode_outcomes(spark, sf_dir):
    return M.request_outcomes(_fields(spark, sf_dir), "request_id", "ord", mode="Block", on_failure="fail-closed")


@query
def restore_full(spark, sf_dir):
    masked = R.with_request_maps(_masked_turns(spark, sf_dir), "conv_id")
    return masked.select("conv_id", "turn", R.replace_placeholders(F.col("masked_text"), F.col("mapping")).alias("restored_text"))


@query
def restore_longest_first(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.expr("'<PERSON_10> и <PERSON_1> ' || cast(c_custkey as string)").alias("text"))
    mapping = F.create_map(F.lit("<PERSON_1>"), F.concat(F.lit("Иван"), F.col("c_custkey").cast("string")), F.lit("<PERSON_10>"), F.lit("Петр"))
    return keys.select("c_custkey", R.replace_placeholders(F.col("text"), mapping).alias("restored_text"))


@query
def mask_unmask_roundtrip(spark, sf_dir):
    rows = M.mask_rows(detect(_documents(spark, sf_dir)))
    same = R.replace_placeholders(F.col("masked_text"), F.col("mapping")) == F.col("text")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


@query
def mapping_entity_counts(spark, sf_dir):
    rows = _mapping(_masked_turns(spark, sf_dir))
    return metrics.counts(rows.select(R.entity_of(F.col("placeholder")).alias("entity_type")), "entity_type")


@query
def mapping_ttl_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("request_id"), F.lit("<PERSON_1>").alias("placeholder"), F.col("o_orderpriority").alias("original"), F.col("o_orderdate").alias("made"))
    stored = mappings.with_expiry(rows, F.col("made"), 86_400 * 3).drop("made")
    asked = orders.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 6).cast("int"))).alias("at"))
    consumed = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("request_id"))
    return mappings.live(stored, asked, "at", consumed).select("request_id", "original")


def _chat(spark, sf_dir, c: DataFrame | None = None):
    """Requests whose messages are a conversation's turns: as text, as blocks, or with tool arguments."""
    c = table(spark, sf_dir, "conversations") if c is None else c
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)  # the text as a JSON string
    blocks = F.concat(F.lit('[{"type":"image_url","text":"no"},{"type":"input_text","text":'), quoted, F.lit('},7,{"text":"plain"}]'))
    message = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"role":"user","content":'), quoted, F.lit("}"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"content":'), blocks, F.lit("}"))).otherwise(F.concat(F.lit('{"content":null,"tool_calls":[{"function":{"arguments":'), quoted, F.lit('}},{"function":null}],"function_call":{"arguments":"f"}}')))
    return c.withColumn("message", message)


def _bodies(spark, sf_dir, template: str, c: DataFrame | None = None) -> DataFrame:
    rows = _chat(spark, sf_dir, c).where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "message"))), lambda x: x["message"]), ",").alias("m"))
    before, after = template.split("@")
    return rows.select("conv_id", F.concat(F.lit(before), "m", F.lit(after)).alias("body"))


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.col("target_ord").cast("long").alias("target_ord"), "path", "text")


@query
def extract_chat_targets(spark, sf_dir):
    return _numbered(T.request_targets(_bodies(spark, sf_dir, '{"model":"m","messages":[@,5],"instructions":"be kind"}')))


@query
def masked_bodies(spark, sf_dir):
    """The texts of requests that have been masked and written back."""
    bodies = _bodies(spark, sf_dir, '{"model":"m","messages":[@,5],"instructions":"be kind"}', turns(spark, sf_dir))
    masked = B.mask_bodies(spread(bodies), "conv_id", entities=["PHONE_NUMBER", "EMAIL_ADDRESS"])
    return _numbered(T.request_targets(masked.select("conv_id", "masked_body"), "masked_body"))


@query
def restored_messages(spark, sf_dir):
    """The texts of response messages with placeholders, after these have been restored and written back."""
    masked = R.with_request_maps(_masked_turns(spark, sf_dir), "conv_id")
    said = _chat(spark, sf_dir, masked.select("conv_id", "turn", F.col("masked_text").alias("text"), "mapping"))
    restored = B.restore_messages(said.select("conv_id", "turn", "message", "mapping"))
    return T.response_targets(restored.select("conv_id", "turn", "restored_message"), "restored_message").select("conv_id", "turn", F.col("target_ord").cast("long").alias("target_ord"), "path", "text")


@query
def extract_responses_targets(spark, sf_dir):
    return _numbered(T.request_targets(_bodies(spark, sf_dir, '{"input":[@,{"type":"text","text":"own","output":[{"text":"o"}]},{"text":"untyped","arguments":"a","output":"p"}],"instructions":["x"]}')))


@query
def extract_response_targets(spark, sf_dir):
    rows = _chat(spark, sf_dir).where("text is not null").select("conv_id", "turn", F.concat(F.regexp_replace("message", "}$", ""), F.lit(',"reasoning_content":"r"}')).alias("message"))
    return T.response_targets(rows).select("conv_id", "turn", F.col("target_ord").cast("long").alias("target_ord"), "path", "text")


@query
def blank_skip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.is_blank(F.when(F.col("turn") % 2 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))).alias("blank"))


@query
def metadata_scrub(spark, sf_dir):
    m = F.create_map(F.lit("pii_request_id"), F.lit("x"), F.lit("user"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.map_keys(T.scrub_metadata(m)), ",").alias("keys"))


#: Tagged tokens made from a key: PER or LOC runs, an orphan I-, a tag change.
TOKENS = "array('Иван', 'Иванов', 'из', 'Москвы', 'Газпром', cast(c_custkey as string))"
TAGS = "case when c_custkey % 4 = 0 then array('B-PER', 'I-PER', 'O', 'B-LOC', 'B-ORG', 'O') when c_custkey % 4 = 1 then array('I-PER', 'B-PER', 'I-LOC', 'I-LOC', 'O', 'B-MISC') when c_custkey % 4 = 2 then array('O', 'B-PER', 'X', 'I-PER', 'B-ORG', 'I-ORG') else array('B-LOC', 'B-LOC', 'O', 'O', 'I-ORG', 'B-PER') end"


def _tagged(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(TOKENS).alias("tokens"), F.expr(TAGS).alias("tags")).withColumn("entities", ner.merge_bio(F.col("tokens"), F.col("tags")))


@query
def bio_merge(spark, sf_dir):
    return _tagged(spark, sf_dir).select("c_custkey", F.posexplode("entities").alias("n", "e")).select("c_custkey", F.col("n").cast("long").alias("n"), F.col("e.tag").alias("tag"), F.array_join("e.parts", "|").alias("parts"))


def _aligned(spark, sf_dir, wanted):
    text = F.concat(F.array_join("tokens", " "), F.lit("; "), F.array_join("tokens", ""))
    rows = _tagged(spark, sf_dir).withColumn("text", text)
    return detected_rows(rows.withColumn("spans", ner.align(F.col("text"), F.col("entities"), wanted)), ["c_custkey"])


@query
def ner_align(spark, sf_dir):
    return _aligned(spark, sf_dir, None)


@query
def ner_gate(spark, sf_dir):
    wanted = ["location", "RU_INN"]
    return _aligned(spark, sf_dir, wanted) if ner.gate(0.7, wanted) and not ner.gate(0.71, None) else _aligned(spark, sf_dir, [])


def _chunks(spark, sf_dir) -> DataFrame:
    """Masked turns, seven characters a chunk, the first with its conversation's mapping."""
    masked = R.with_request_maps(_masked_turns(spark, sf_dir), "conv_id")
    n = F.ceil(F.length("masked_text") / 7)
    rows = masked.select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("choice_index"), F.lit("content").alias("field"), "mapping", "masked_text", n.alias("n"))
    rows = rows.withColumn("pieces", F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: F.struct(k.alias("seq"), F.substring(F.col("masked_text"), ((k - 1) * 7 + 1).cast("int"), F.lit(7)).alias("delta"))))
    return rows.select("request_id", "choice_index", "field", "mapping", F.explode("pieces").alias("p"), "n").select("request_id", "choice_index", "field", "p.seq", "p.delta", F.when(F.col("p.seq") == F.col("n"), "stop").alias("finish_reason"), F.when(F.col("p.seq") == 1, F.col("mapping")).alias("mapping"))


def _texts(out: DataFrame) -> DataFrame:
    """What was passed on, joined."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "emitted")))
    return out.groupBy(F.col("request_id").cast("long").alias("request_id"), F.col("choice_index").cast("long").alias("turn")).agg(F.array_join(parts["emitted"], "").alias("text"))


@query
def stream_restore_windowed(spark, sf_dir):
    return _texts(replacer.restore_chunks(_chunks(spark, sf_dir)))


@query
def stream_finish_empty_delta(spark, sf_dir):
    """As providers send it: the last chunk has an empty delta and the finish_reason; it ends what both fields hold back."""
    last = F.col("finish_reason").isNotNull()
    cut = _chunks(spark, sf_dir).withColumn("delta", F.when(last, F.concat("delta", F.lit("<PHONE_"))).otherwise(F.col("delta")))
    quoted = F.to_json(F.struct(F.struct("delta").alias("x")))
    content = F.regexp_extract(quoted, r'(?s)^\{"x":\{"delta":(.*)\}\}$', 1)
    chunk = F.concat(F.lit('{"choices":[{"index":'), F.col("choice_index").cast("string"), F.lit(',"delta":{"content":'), content, F.lit(',"reasoning_content":"<EMAIL_"}}]}'))
    end = F.concat(F.lit('{"choices":[{"index":'), F.col("choice_index").cast("string"), F.lit(',"delta":{},"finish_reason":"stop"}]}'))
    body = cut.select("request_id", "mapping", F.explode(F.when(last, F.array(F.struct("seq", chunk.alias("chunk")), F.struct((F.col("seq") + 1).alias("seq"), end.alias("chunk")))).otherwise(F.array(F.struct("seq", chunk.alias("chunk"))))).alias("c")).select("request_id", "mapping", "c.*")
    out = replacer.restore_chunks(T.delta_targets(body))
    parts = F.array_sort(F.collect_list(F.struct("seq", "emitted")))
    return out.groupBy("request_id", F.col("choice_index").cast("long").alias("turn"), "field").agg(F.array_join(parts["emitted"], "").alias("text"), F.max("seq").alias("last_seq"))


@query
def stream_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    streams = table(spark, sf_dir, "orders").select(F.when(k % 11 != 0, k).alias("request_id"), (k % 5 != 0).alias("has_mapping"), (k % 7 == 0).alias("load_failed"), (k % 3 == 0).alias("upstream_failed"), (k % 2 == 0).alias("changed"))
    return metrics.counts(replacer.stream_outcomes(streams, on_failure="fail-closed"), "result", "action", "done", "delete_mapping")


@query
def rates_5m(spark, sf_dir):
    return metrics.rates(table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query
def latency_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100), "seconds", metrics.ANALYZER_BUCKETS, "event_type").select("event_type", "le", "n")


@query
def latency_p95(spark, sf_dir):
    h = metrics.histogram(table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100), "seconds", metrics.ANALYZER_BUCKETS, "event_type")
    return metrics.quantile(h, 0.95, "event_type").select("event_type", F.round("value", 6).alias("p95"))


@query
def store_latency_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 1000), "seconds", metrics.STORE_BUCKETS, "event_type").select("event_type", "le", "n")


@query
def blocked_entity_counts(spark, sf_dir):
    return metrics.blocked_entities(_turn_spans(spark, sf_dir), "conv_id")


@query
def failure_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    operation = F.element_at(F.array(*map(F.lit, ("masking", "mapping_save", "mapping_load", "mapping_delete"))), (k % 4 + 1).cast("int"))
    tried = table(spark, sf_dir, "orders").select(operation.alias("operation"), F.when(k % 6 == 0, "failed").when(k % 35 == 0, "overloaded").alias("error"))
    return metrics.failures(tried, "operation", "error", "fail-closed")


@query
def log_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", metrics.log_line("pii_masked", request_id=F.col("c_custkey").cast("string"), masked_count=F.col("c_custkey") % 7, entity=F.lit("тип")).alias("line"))


@query
def guardrail_hooks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("pii"), F.lit("x"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("y"))).alias("guardrails"))
    on = routing.guarded(o, "pii", True).select("o_orderkey", F.lit("on").alias("how"))
    return on.unionByName(routing.guarded(o, "pii", False).select("o_orderkey", F.lit("asked").alias("how")))


def _access(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.array(F.when(F.col("c_custkey") % 2 == 0, "standard").otherwise("premium"), F.lower("c_mktsegment")).alias("groups"))
    deployments = spark.createDataFrame([("a-1", "small", ["standard", "open"], True), ("a-2", "small", ["standard"], False), ("b-1", "large", ["premium"], True), ("b-2", "large", ["premium", "building"], True), ("c-1", "own", ["building"], True)], "deployment_id string, model_name string, access_groups array<string>, healthy boolean")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("key_id"), F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("own")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("model_name"), F.col("o_orderdate").alias("ts"))
    return keys, deployments, requests


@query
def model_access_semi(spark, sf_dir):
    keys, deployments, requests = _access(spark, sf_dir)
    return routing.with_access(requests, keys, deployments).select("request_id", "key_id", "model_name")


@query
def auth_reject(spark, sf_dir):
    keys, _, requests = _access(spark, sf_dir)
    return routing.unknown_keys(requests, keys.where("key_id % 5 <> 0")).select("request_id", "key_id")


@query
def sticky_routing(spark, sf_dir):
    _, deployments, requests = _access(spark, sf_dir)
    used = requests.where("request_id % 4 = 0 and model_name = 'large'").select("key_id", "model_name", F.lit("b-2").alias("deployment_id"), F.col("ts").alias("used_at"))
    return routing.sticky(requests, deployments, used, 86_400 * 200).select("request_id", "deployment_id", "sticky")


@query
def response_outcome_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    fields = o.select(F.when(k % 13 != 0, F.col("o_custkey")).alias("request_id"), (F.col("o_custkey") % 5 != 0).alias("has_mapping"), (F.col("o_custkey") % 29 == 0).alias("load_failed"), (F.col("o_custkey") % 7 != 0).alias("supported"), (F.col("o_custkey") % 3 == 0).alias("stream"), (F.col("o_custkey") % 6 == 0).alias("stream_done"), F.lit("a").alias("text"), F.when(F.col("o_custkey") % 2 == 0, "b").otherwise("a").alias("restored_text"))
    return metrics.counts(R.response_outcomes(fields, "request_id"), "result", "delete_mapping")


def stream_restore_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form over written chunks, run to its end; the sink's table is returned."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _chunks(spark, sf_dir).withColumn("request_id", F.col("request_id").cast("string")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    q = replacer.restore_stream(stream, idle=None).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return _texts(spark.read.parquet(f"{at}/out"))


QUERIES["stream_restore_stateful"] = stream_restore_stateful
