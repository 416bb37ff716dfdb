"""Inputs of the queries.

``documents`` holds e-mails, phones, IPv4 addresses and card numbers, but no forms.  Forms with
labels, names, addresses, dates and regional ids are therefore derived from ``orders``, one per
order, by SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_A_TASK = 10_000


def _n(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def _pick(expr: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {whens} END"


_K, _C = "o_orderkey", "o_custkey"
_DAY, _MON, _YEAR = _n("day(o_orderdate)", 2), _n("month(o_orderdate)", 2), "CAST(year(o_orderdate) AS STRING)"
_FIRST = _pick(_K, "John", "Maria", "Anna-Lena", "Peter", "Olga Maria")
_LAST = _pick(_C, "Smith", "Weber", "Novak", "Brown", "Garcia", "Moreau", "Rossi")
_RU_LAST = _pick(_C, "Иванов", "Петрова", "Сидоров")
_RU_FIRST = _pick(_K, "Иван", "Анна", "Пётр")
_RU_MID = _pick(f"({_C} + {_K})", "Иванович", "Петровна", "Ильич")
_NL = "chr(10)"

_ENGLISH = f"""concat('Applicant: ', {_FIRST}, ' ', {_LAST}, {_NL}, 'born ', {_DAY}, '.', {_MON}, '.', {_YEAR},
 '; seen ', {_YEAR}, '-', {_MON}, '-', {_DAY}, '; phone +1 (', {_n(f'{_C} % 1000', 3)}, ') ', {_n(f'{_K} % 1000', 3)}, '-',
 {_n(f'{_C} % 10000', 4)}, '; mail ', lower({_LAST}), CAST({_C} % 50 AS STRING), '@mail', CAST({_K} % 7 AS STRING), '.example.com', {_NL},
 'Address: ', CAST(1 + {_C} % 400 AS STRING), ' Baker ', {_pick(_C, 'Street', 'Road', 'Ave.', 'Lane')}, {_NL}, {_n(f'{_C} % 100000', 5)}, ' Springfield; end')"""
_GERMAN = f"""concat('Antragsteller: ', {_FIRST}, ' ', {_LAST}, ', Kunde ', CAST({_K} AS STRING), {_NL}, 'Anschrift: ',
 {_pick(_C, 'Alte Allee', 'Muster Str.', 'Am Neuen Ring', 'Ähren Weg')}, ' ', CAST(1 + {_C} % 90 AS STRING), {_pick(_K, '', 'a')}, {_NL},
 {_n(f'{_K} % 100000', 5)}, ' ', {_pick(_C, 'Berlin', 'Bad Homburg', 'Köln')}, '; ', {_n(f'{_C} % 100000', 5)}, '-', {_n(f'{_K} % 10000', 4)}, ' Springfield.')"""
_RUSSIAN = f"""concat('ФИО: ', {_RU_LAST}, ' ', {_RU_FIRST}, ' ', {_RU_MID}, '; ФАМИЛИЯ: ', upper({_RU_LAST}), ' ', upper({_RU_FIRST}), ' ', upper({_RU_MID}),
 '; имя: ', {_RU_FIRST}, ' ', {_RU_LAST}, '; паспорт 45 11 ', {_n(f'{_C} % 1000000', 6)}, '; ИНН ', {_n(f'{_K} % 100000', 10)}, '; инн ', {_n(f'{_C} % 1000', 12)},
 '; СНИЛС ', {_n(f'{_C} % 1000', 3)}, '-', {_n(f'{_K} % 1000', 3)}, '-', {_n(f'{_C} % 997', 3)}, ' ', {_n(f'{_K} % 100', 2)},
 '; адрес 2ул. Ленина, д. ', CAST(1 + {_C} % 200 AS STRING), ', ', {_n(f'{_C} % 1000000', 6)}, ' г. Москва2; дата ', CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '-', {_YEAR})"""
_IDS = f"""concat('Passport AB', {_n(f'{_C} % 10000000', 7)}, '; document no C', {_n(f'{_C} % 100', 2)}, 'X', {_n(f'{_K} % 100000', 5)},
 '; VAT DE', {_n(f'{_C} % 1000000000', 9)}, '; residence permit 12AB', {_n(f'{_K} % 100000', 5)}, '; ssn ', {_n(f'{_C} % 100000', 10)},
 '; tin ', {_n(f'{_K} % 100000000', 8)}, '; անձնագիր CD', {_n(f'{_K} % 10000000', 7)}, '; again AB', {_n(f'{_C} % 10000000', 7)})"""
_MONEY = f"""concat('IBAN DE', {_n(f'{_C} % 100', 2)}, {_n(f'{_K}', 18)}, '; SWIFT DEUTDEFF', {_pick(_C, '', 'XXX')}, '; card 4111 1111 ', {_n(f'{_C} % 10000', 4)}, ' ', {_n(f'{_K} % 10000', 4)},
 '; old card 42222222', {_n(f'{_K} % 100000', 5)}, '; long ', {_n(f'{_C}', 17)}, '; account ', {_n(f'{_K}', 20)}, '; card ', {_n(f'{_C}', 16)})"""
_NETWORK = f"""concat('hosts 10.', CAST({_C} % 300 AS STRING), '.', CAST({_K} % 256 AS STRING), '.1, 2001:0db8:85a3:0000:0000:8a2e:', {_n(f'{_K} % 10000', 4)}, ':',
 {_n(f'{_C} % 10000', 4)}, ' and ::', CAST({_K} % 10000 AS STRING), ', call foo::bar(), mac 00:1a:2b:3c:4d:', {_n(f'{_C} % 100', 2)}, '; tel ', {_n(f'{_C} % 1000000000', 9)},
 ' or ', {_n(f'{_K}', 9)}, '/', CAST({_C} AS STRING))"""

FORM_TEXT = (
    f"CASE {_K} % 6 WHEN 0 THEN {_ENGLISH} WHEN 1 THEN {_GERMAN} WHEN 2 THEN {_RUSSIAN} "
    f"WHEN 3 THEN {_IDS} WHEN 4 THEN {_MONEY} ELSE {_NETWORK} END"
)
FORM_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'ru' WHEN 3 THEN 'ids' WHEN 4 THEN 'money' ELSE 'net' END"

# Notes that name customers, for long literal lists.
NOTE_TEXT = (
    f"concat('order ', CAST({_K} AS STRING), ' of Customer#', {_n(_C, 9)}, ', copy to Customer#', {_n(f'({_C} * 7) % 100', 9)}, "
    f"'; not Customer#', CAST({_C} AS STRING))"
)


# The same with contacts, which the rules detect beside the listed names.
MAIL_NOTE_TEXT = f"concat({NOTE_TEXT}, '; mail c', CAST({_C} AS STRING), '@shop.example.com, host 10.0.0.', CAST({_K} % 256 AS STRING))"


# Entries of a register with what the extended profile adds: a street and a town at word edges, a double colon inside an address, a passport.
REGISTER_PARTS = (
    "'адрес: '", f"concat('ул. Ленина, д. ', CAST(1 + {_C} % 200 AS STRING))", "'; индекс '", f"concat({_n(f'{_C} % 1000000', 6)}, ' г. Москва')",
    "'; узел '", f"concat('2001:db8::', CAST({_K} % 10000 AS STRING))", "'; паспорт '", f"concat('45 11 ', {_n(f'{_K} % 1000000', 6)})",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders in tasks of at most some thousand rows.

    A text made of an order is many times its size, and the work on it more so; splits of the file, cut by
    its bytes and row groups, would leave a million texts to one task.  The rows are counted from the
    footers and dealt in turn, so that equal or null keys are spread too.
    """
    orders = table(spark, sf_dir, "orders").select(*columns)
    tasks = -(-orders.count() // ROWS_A_TASK)
    return orders.repartition(tasks) if tasks > 1 else orders


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate")
    return orders.selectExpr("o_orderkey AS doc_id", f"{FORM_TEXT} AS text", f"{FORM_KIND} AS kind")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey")
    return orders.selectExpr("o_orderkey AS doc_id", f"{NOTE_TEXT} AS text")


def mail_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey")
    return orders.selectExpr("o_orderkey AS doc_id", f"{MAIL_NOTE_TEXT} AS text")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir, "o_orderkey", "o_custkey")
    return orders.selectExpr("o_orderkey AS doc_id", f"concat({', '.join(REGISTER_PARTS)}) AS text")
