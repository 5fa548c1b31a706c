"""Texts with personal numbers made from keys of the driver's tables; the expressions mean the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(key: str, factor: int, plus: int, width: int) -> str:
    return f"lpad(cast(({key} * {factor} + {plus}) % {10**width} as string), {width}, '0')"


N9, N10, N11, N12 = (_number("c_custkey", f, p, w) for f, p, w in ((7_368_787, 11, 9), (7_919, 1_234_567, 10), (699_937, 11_223_344_595, 11), (3_246_599, 500_100_732_259, 12)))

# one expression a text over `customer`
TEXTS = {
    "phone": f"'тел +7 (' || substr({N10}, 1, 3) || ') ' || substr({N10}, 4, 3) || '-' || substr({N10}, 7, 2) || '-' || substr({N10}, 9, 2) || ', моб 9' || {N9}",
    "inn": f"'ИНН ' || {N10} || ' или ' || {N12} || '.'",
    "inn_strict": f"case when c_custkey % 2 = 0 then 'ИНН ' else 'код ' end || {N10}",
    "snils": f"'СНИЛС ' || substr({N11}, 1, 3) || '-' || substr({N11}, 4, 3) || '-' || substr({N11}, 7, 3) || ' ' || substr({N11}, 10, 2)",
    "passport": f"'Паспорт ' || substr({N10}, 1, 4) || ' ' || substr({N10}, 5, 6) || ', ' || substr({N10}, 9, 2) || ' ' || substr({N10}, 7, 2) || ' ' || substr({N10}, 1, 6)",
    "address": "'Адрес: ул. Ленина, д. ' || cast(c_custkey % 90 + 1 as string) || ', кв. ' || cast(c_custkey % 50 + 1 as string) || '; Тверская улица, дом ' || cast(c_custkey % 30 + 1 as string) || '. Отчет улица продаж выросла на 10'",
}

TURN_TEXT = "text || ' тел +7 903 ' || lpad(cast(conv_id % 1000 as string), 3, '0') || ' 45 ' || lpad(cast(turn % 100 as string), 2, '0') || ', почта user' || cast(conv_id as string) || '@mail.example.com'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(TEXTS[what]).alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(TURN_TEXT).alias("text"))
