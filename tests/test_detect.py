import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.operators import mask as M
from veilspark.operators import ner, restore, spans, targets
from veilspark.operators.detect import detect, detected_rows
from veilspark.plans.config import Settings
from veilspark.streaming.replacer import passed_on, restore_chunks

CASES = [
    ("PHONE_NUMBER", "Диспетчер ответит по +7 921 555 10 20 до шести", True), ("PHONE_NUMBER", "Запасной 89215551020, доб. нет", True), ("PHONE_NUMBER", "офис 8 (812) 555-10-20", True), ("PHONE_NUMBER", "на складе 54321 коробка", False),
    ("EMAIL_ADDRESS", "счёт уйдёт на buh.otdel@zavod-7.example", True), ("EMAIL_ADDRESS", "пишите: p_orlov@pochta.example.org.", True),
    ("RU_INN", "реквизиты: 7707083893, Самара", True), ("RU_INN", "предприниматель 500100732259 зарегистрирован", True), ("RU_INN", "реквизиты: 7707083895", False),
    ("RU_SNILS", "карточка 112-233-445 95 выдана", True), ("RU_SNILS", "карточка 112-233-445 01 выдана", False),
    ("RU_PASSPORT", "предъявлен 46 09 654321", True), ("RU_PASSPORT", "предъявлен 4609 654321", True), ("RU_PASSPORT", "предъявлен 00 09 654321", False),
    ("CREDIT_CARD", "списано с 5555 5555 5555 4444", True), ("CREDIT_CARD", "списано с 5555 5555 5555 4445", False),
    ("RU_ADDRESS", "доставка: ул. Садовая, д. 3, кв. 12", True), ("RU_ADDRESS", "склад на проспект Победы, дом 8", True), ("RU_ADDRESS", "г. Псков, ул. Мирная, д. 2", True), ("RU_ADDRESS", "Заречная улица, дом 11", True),
    ("RU_ADDRESS", "За год улица торговли прибавила 12 процентов", False), ("RU_ADDRESS", "Дом моды открылся в 9 часов", False), ("RU_ADDRESS", "Адрес письма прежний", False),
]


def test_recognizer_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "id int, text string")
    found = {(r.id, r.entity_type) for r in detected_rows(detect(df), ["id"]).collect()}
    for i, (entity, text, expected) in enumerate(CASES):
        assert ((i, entity) in found) == expected, text


def test_bare_and_strict_numbers(spark):
    df = spark.createDataFrame([(0, "7707083893"), (1, "ИНН: 7707083893"), (2, None), (3, "")], "id int, text string")
    ids = lambda **how: sorted(r.id for r in detected_rows(detect(df, entities=["ru_inn"], **how), ["id"]).collect())
    assert ids() == [0, 1]
    assert ids(detect_bare_inn=False) == [1]


def test_bad_and_overlapping_spans(spark):
    raw = "array(struct('X', -1, 3, 1D, ''), struct('RU_INN', 4, 14, 1D, ''), struct('PHONE', 4, 10, 1D, ''))"
    df = spark.createDataFrame([(1, 0, "ИНН 7707083893")], "r int, o int, text string").withColumn("spans", F.expr(raw).cast(spans.SPANS))
    masked, mapping = M.mask(df, "r", "o")
    assert masked.first().masked_text == "ИНН <RU_INN_1>"
    assert [tuple(r) for r in mapping.collect()] == [(1, "<RU_INN_1>", "7707083893", "RU_INN")]


def test_equal_values_get_numbers_of_their_own(spark):
    df = detect(spark.createDataFrame([(1, 0, "Телефоны +79031234567 и +79031234567"), (1, 1, "снова 89031234567")], "r int, o int, text string"))
    rows = {r.o: r.masked_text for r in M.mask(df, "r", "o")[0].collect()}
    assert rows == {0: "Телефоны <PHONE_NUMBER_1> и <PHONE_NUMBER_2>", 1: "снова <PHONE_NUMBER_3>"}


def test_longest_placeholder_first(spark):
    m = F.create_map(F.lit("<PERSON_1>"), F.lit("Иван"), F.lit("<PERSON_10>"), F.lit("Петр"))
    assert spark.range(1).select(restore.replace_placeholders(F.lit("<PERSON_10> и <PERSON_1>"), m)).first()[0] == "Петр и Иван"


def test_offsets_are_code_points(spark):
    r = detected_rows(detect(spark.createDataFrame([("😀 a@b.com",)], "text string"), entities=["EMAIL_ADDRESS"]), []).first()
    assert (r.start, r.end, r.text) == (2, 9, "a@b.com")


def test_targets_of_odd_bodies(spark):
    bodies = ['{"messages":[{"content":"[not a list]"},{"content":[{"text":"a"},{"type":"image","text":"b"}]},null,7]}', "no json", "{}", None, '{"input":["x",{"text":"untyped"}],"messages":"m"}']
    df = targets.request_targets(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    got = {}
    for r in df.collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {0: ["[not a list]", "a"], 1: [None], 2: [None], 3: [None], 4: [None]}


def test_repeated_entities_align_in_order(spark):
    text = "Иван Иванов встретил Иван Иванов"
    e = ner.merge_bio(F.array(*map(F.lit, text.split())), F.array(*map(F.lit, ["B-PER", "I-PER", "O", "B-PER", "I-PER"])))
    found = spark.range(1).select(ner.align(F.lit(text), e).alias("s")).first().s
    assert [(x.start, x.end) for x in found] == [(0, 11), (21, 32)]


def test_settings_fall_back():
    s = Settings.read({"VEIL_MODE": " Block ", "VEIL_MAPPING_TTL_SECONDS": "-1", "VEIL_DETECT_BARE_INN": "off", "VEIL_ON_FAILURE": "?"})
    assert (s.mode, s.mapping_ttl_seconds, s.detect_bare_inn, s.on_failure) == ("block", 3600, False, "fail_open")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<P_1>", "<P_10>", "<P_", "1", ">", "a", "<", " "]), max_size=12), st.lists(st.integers(0, 40), max_size=6))
def test_any_chunking_restores_the_same_text(parts, cuts):
    text, mapping = "".join(parts), {"<P_1>": "Иван", "<P_10>": "Петр"}
    whole = text.replace("<P_10>", "Петр").replace("<P_1>", "Иван")
    at = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    held, out = "", []
    for a, b in zip(at, at[1:]):
        new, held = passed_on(held, text[a:b], mapping)
        assert not any(p.startswith(held) and p == held for p in mapping)
        out.append(new)
    assert "".join([*out, passed_on(held, "", mapping, True)[0]]) == whole


def test_batch_chunks_restore_the_same_text(spark):
    """Random texts and cuts, empty chunks and finishes in the middle: each field's parts join to the restored text."""
    r = random.Random(4)
    mapping = {"<P_1>": "Иван", "<P_10>": "Петр"}
    rows, want = [], {}
    for i in range(60):
        seq = 0
        for field in ("content", "reasoning_content"):
            text = "".join(r.choice(["<P_1>", "<P_10>", "<P_", "1", ">", "a", "<", " "]) for _ in range(r.randint(0, 12)))
            at = sorted({0, len(text), *(r.randint(0, len(text)) for _ in range(4))})
            parts = [text[a:b] for a, b in zip(at, at[1:])] or [""]
            parts.insert(r.randint(0, len(parts)), "")
            want[i, field] = text.replace("<P_10>", "Петр").replace("<P_1>", "Иван")
            for p in parts:
                rows.append((str(i), 0, field, seq, p, None))
                seq += 1
        rows.append((str(i), 0, None, seq, None, "stop"))
    chunks = spark.createDataFrame(rows, "request_id string, choice_index int, field string, seq long, delta string, finish_reason string")
    stored = spark.createDataFrame([(str(i), p, o) for i in range(60) for p, o in mapping.items()], "request_id string, placeholder string, original string")
    got = {}
    for x in sorted(restore_chunks(chunks, stored).collect(), key=lambda x: x.seq):
        got[int(x.request_id), x.field] = got.get((int(x.request_id), x.field), "") + x.emitted
    assert got == want


def test_a_finish_ends_the_fields_of_its_choice_only(spark):
    rows = [("r", 0, "content", 1, "a <P_", None), ("r", 1, "content", 2, "b <P_", None), ("r", 0, "reasoning_content", 3, "c <", None), ("r", 0, None, 4, None, "stop"), ("r", 1, "content", 5, "1>", None)]
    chunks = spark.createDataFrame(rows, "request_id string, choice_index int, field string, seq long, delta string, finish_reason string")
    out = restore_chunks(chunks, spark.createDataFrame([("r", "<P_1>", "x")], "request_id string, placeholder string, original string"))
    got = sorted((x.choice_index, x.field, x.seq, x.emitted) for x in out.collect())
    assert got == [(0, "content", 1, "a "), (0, "content", 4, "<P_"), (0, "reasoning_content", 3, "c "), (0, "reasoning_content", 4, "<"), (1, "content", 2, "b "), (1, "content", 5, "x")]


def test_each_pattern_stands_once_in_the_plan(spark):
    from veilspark.functions.patterns import RECOGNIZERS
    from veilspark.plans.queries import QUERIES

    for name in ("detect_all", "entity_counts", "mask_documents", "mask_conversations", "restore_full", "stream_restore_windowed"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("$0") <= sum(len(r.patterns) for r in RECOGNIZERS), name
        assert plan.count("parquet") == 1, name


def test_long_texts_and_fields_take_linear_work(spark):
    """20,000 spans in a text and 100,000 chunks of a field, in seconds."""
    start = time.time()
    text = "слово a.b@mail.example.com и 😀 " * 20_000
    rows = M.mask_rows(detect(spark.createDataFrame([(text,)], "text string"), entities=["EMAIL_ADDRESS"]))
    got = rows.select("masked_text", F.size("mapping").alias("n"), restore.replace_placeholders(F.col("masked_text"), F.col("mapping")).alias("back")).first()
    assert got.masked_text == "".join(f"слово <EMAIL_ADDRESS_{k}> и 😀 " for k in range(1, 20_001)) and got.n == 20_000 and got.back == text
    masked = "слово <P_1> и " * 12_500
    pieces = spark.createDataFrame([("r", 0, "content", k, masked[k * 2 : k * 2 + 2], None) for k in range(len(masked) // 2)], "request_id string, choice_index int, field string, seq long, delta string, finish_reason string")
    out = restore_chunks(pieces, spark.createDataFrame([("r", "<P_1>", "Иван")], "request_id string, placeholder string, original string")).orderBy("seq").collect()
    assert len(out) == len(masked) // 2 and "".join(x.emitted for x in out) == masked.replace("<P_1>", "Иван")
    assert time.time() - start < 120


def test_digits_of_other_scripts(spark):
    """\\d is Unicode's in the patterns and in the tests before them."""
    df = spark.createDataFrame([("+7\u0669\u0661\u0662 345 67 89",)], "text string")
    assert [r.entity_type for r in detected_rows(detect(df, entities=["PHONE_NUMBER"]), []).collect()] == ["PHONE_NUMBER"]


def test_private_characters_in_a_text(spark):
    text = "\ue000a.b@c.example\ue001 \ue002 d@e.example"
    r = M.mask_rows(detect(spark.createDataFrame([(text,)], "text string"))).first()
    assert r.masked_text == "\ue000<EMAIL_ADDRESS_1>\ue001 \ue002 <EMAIL_ADDRESS_2>" and r.mapping["<EMAIL_ADDRESS_1>"] == "a.b@c.example"


def test_originals_that_look_like_placeholders(spark):
    """The sequential rule is kept where one pass would differ."""
    for text, mapping in (("<A_1> <A_2>", {"<A_1>": "<A_2>", "<A_2>": "x"}), ("<A_<B_1>", {"<B_1>": "1>", "<A_1>": "y"}), ("<A_1", {"<A_1>": "z"}), ("q<A_1>q<A_3>", {"<A_1>": "z", "q": "w"})):
        want = text
        for p in sorted(mapping, key=lambda p: (-len(p), p)):
            want = want.replace(p, mapping[p])
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        assert spark.range(1).select(restore.replace_placeholders(F.lit(text), m)).first()[0] == want


def test_spans_in_clusters_resolve_as_one_list(spark):
    r = random.Random(8)
    lists = [[(r.choice("AB"), a := r.randint(0, 60), a + r.randint(1, 9), r.choice([0.5, 0.7, 1.0]), "") for _ in range(r.randint(0, 40))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(lists)), f"id int, s {spans.SPANS}")

    def greedy(found, clash):
        kept = []
        for x in found:
            if not any(clash(k, x) for k in kept):
                kept.append(x)
        return kept

    for x in df.select("id", spans.resolve(F.col("s")).alias("one"), spans.resolve_by_score(F.col("s")).alias("two"), spans.normalise(F.col("s"), F.lit("x" * 66)).alias("three")).collect():
        best = sorted(lists[x.id], key=lambda s: (-s[3], s[1], s[1] - s[2]))
        over = lambda k, s: s[1] < k[2] and k[1] < s[2]
        inner = greedy(best, lambda k, s: k[0] == s[0] and k[1] <= s[1] and s[2] <= k[2])
        assert [tuple(s) for s in x.one] == sorted(greedy(inner, over), key=lambda s: s[1])
        assert [tuple(s) for s in x.two] == sorted(greedy(sorted(lists[x.id], key=lambda s: -s[3]), over), key=lambda s: s[1])
        fit = sorted((s for s in lists[x.id] if s[2] <= 66), key=lambda s: (s[1], s[1] - s[2]))
        assert [(s.start, s.end) for s in x.three] == [s[1:3] for s in greedy(fit, over)]


def test_block_policy_scans_every_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "write to a.b@mail.example.com"), (2, 0, "user", "nothing here"), (2, 1, "user", None), (3, 0, "user", "hello")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    from veilspark.plans.queries import QUERIES

    got = {x.conv_id: (x.blocked, x.entities) for x in QUERIES["block_policy"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, "EMAIL_ADDRESS"), 2: (False, ""), 3: (True, "EMAIL_ADDRESS,PHONE_NUMBER")}
