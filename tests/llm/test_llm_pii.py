import datetime
import re

from pyspark.sql import functions as F

from orelode.llm import pii, queries

KEY = "k"


def changed(spark, texts, key=KEY):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def mod97(iban):
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def test_grids_are_permuted(spark):
    """Every cell once: the network is a bijection of the grid."""
    cells = spark.range(17 * 23).select(F.floor(F.col("id") / 23).alias("x"), (F.col("id") % 23).alias("y"))
    moved = cells.select(pii.permute(F.col("x"), F.col("y"), (F.lit(17), F.lit(23)), "t", KEY).alias("p")).collect()
    assert {(r.p.x, r.p.y) for r in moved} == {(x, y) for x in range(17) for y in range(23)}
    assert sum((r.p.x, r.p.y) == divmod(i, 23) for i, r in enumerate(moved)) < 20


def test_digit_strings_are_permuted(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert len({r.p for r in rows.select(pii.permute_digits(F.col("d"), "t", KEY).alias("p")).collect()}) == 1000


CASES = [
    ("4111 1111 1111 1111", luhn), ("4111-1111-1111-1111", luhn), ("378282246310005", luhn), ("3782 822463 10005", luhn),
    ("4785380592391139", luhn), ("GB82 WEST 1234 5698 7654 32", lambda x: mod97(x) == 1),
    ("DE89370400440532013000", lambda x: mod97(x) == 1),
    ("123-45-6789", lambda x: x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] > "00" and x[7:] > "0000"),
    ("+1 (743) 555-3824", lambda x: x[4] > "1" and x[9] > "1" and x.startswith("+1 (")), ("743-555-3824", lambda x: x[0] > "1"),
    ("+1 (143) 555-3824", lambda x: x[4] < "2"), ("743-155-3824", lambda x: x[0] > "1" and x[4] < "2"),
    ("+49 30 12345678", lambda x: x.startswith("+49 ")), ("152.143.123.131", lambda x: all(int(p) < 256 for p in x.split("."))),
    ("1984-02-29", lambda x: datetime.date.fromisoformat(x)), ("31.12.2001", lambda x: datetime.datetime.strptime(x, "%d.%m.%Y")),
    ("12/31/2001", lambda x: datetime.datetime.strptime(x, "%m/%d/%Y")), ("3/4/1999", lambda x: datetime.datetime.strptime(x, "%d/%m/%Y"))]


def test_values_stay_valid_in_their_format(spark):
    values = [v for v, _ in CASES]
    got = changed(spark, values)
    for (value, valid), new in zip(CASES, got, strict=True):
        assert new != value and valid(new), (value, new)
        if "/" not in value:
            shape = "[0-9]+" if "." in value else "[0-9]"
            assert re.sub(shape, "9", new) == re.sub(shape, "9", value)


def test_equal_values_stay_linked(spark):
    values = [v for v, _ in CASES] + ["joe.doe@mail.example.com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    first, framed, again = changed(spark, values), changed(spark, [f"x {v}, y%%% {v} z." for v in values]), changed(spark, values)
    assert first == again
    assert framed == [f"x {v}, y%%% {v} z." for v in first]
    assert all(a != b for a, b in zip(first, changed(spark, values, "other"), strict=True))
    assert changed(spark, ["4111 1111 1111 1111"])[0].replace(" ", "") == changed(spark, ["4111111111111111"])[0]


def test_other_text_is_left(spark):
    texts = ["4111111111111112", "1984-02-30", "666-12-1234", "000-11-1111", "999.1.1.1", "DE89370400440532013001", "v1.2.3",
             "page 12 of 2001", "12345678901234567890123", "a@b", "13/13/2001", "1899-12-31", "2100-01-01", "", "no digits here"]
    assert changed(spark, texts) == texts


def test_everything_around_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.pseudonymise(docs, KEY).collect()
    assert len(rows) == len(before)
    private = re.compile(rf"{pii.EMAIL}|(?<!\d)\d{{16}}(?!\d)|\+\d \(\d{{3}}\) \d{{3}}-\d{{4}}|(?:\d{{1,3}}\.){{3}}\d{{1,3}}")
    some = 0
    for r in rows:
        old = private.findall(before[r.doc_id])
        some += len(old)
        assert not [x for x in old if x in r.text and (not x.isdigit() or luhn(x))]
        if not re.search(r"[0-9@=:]", before[r.doc_id]):
            assert r.text == before[r.doc_id] and not r.changed
        assert private.split(before[r.doc_id])[0][:20] == r.text[:20] or r.changed
    assert some


def test_plan_is_native(spark, sf):
    plan = queries.QUERIES["op10_pii"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_awkward_rows(awkward, no_docs):
    rows = pii.pseudonymise(awkward, KEY).collect()
    assert len(rows) == awkward.count() and rows[0].asDict().keys() == {"doc_id", "text", "changed"}
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in awkward.collect())
    assert not any(r.changed for r in rows)
    assert pii.pseudonymise(no_docs, KEY).count() == 0
