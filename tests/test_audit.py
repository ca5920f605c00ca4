"""The change marks of cleaning against a plain count over the kept rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.spec import Spec

SPEC = Spec(
    id="k", reference=None, portfolio=None, url=None, description="text", category=None, price="price", price_group="kind", mode=None, type=None,
    places=(), state=None, published="day", received=None, opened=None, effective=None, duration="span", duration_unit="unit", multi_value=None,
    direct_responses=None, responses=(), suppliers=None, ratio_denominator=None, counters=("n",), text=("k", "kind"), critical=("day", "text"),
    leakage=("gone",), redundant=(), traceability=("k",), tie_break=("n",),
)
SCHEMA = "k string, kind string, text string, price double, day string, span double, unit string, n int, gone string, other string"
ROWS = [
    ("a", "X", " two  words ", -1.0, "2024-01-01", 1.0, "Mes(es)", -2, "g", "o"),
    ("a", "X", "two words", None, "2024-01-01", 1.0, "Mes(es)", None, "g", "o"),  # the same once cleaned
    ("a", "X", "two words", None, "2024-01-01", 1.0, "Mes(es)", None, "g", "o"),
    ("b", "N/A", "N/A", float("nan"), "no day", None, None, 1, " g", None),
    ("c", "Y", "w", 5.0, "2024-02-01", -3.0, "whatever", 1, None, " "),
    ("c", "Y", None, 5.0, "2024-02-01", -3.0, "whatever", 1, None, None),  # less complete, so it goes
    ("d", None, None, None, None, None, None, None, None, None),
]
COPIES = 3  # of each row, so that a hot key combines


def test_marks_survive_both_deduplications(spark):
    from assayer.operators.audit import KINDS, cleaning_audit
    from assayer.plans.clean import clean

    df = spark.createDataFrame(ROWS * COPIES, SCHEMA).repartition(5)
    cleaned = clean(df, SPEC, nfkc=False, track=True)
    plain = clean(df, SPEC, nfkc=False)
    assert plain.columns == [c for c in cleaned.columns if not c.startswith("changed_") and c not in ("raw_rows", "distinct_rows")]
    ordered = lambda t: sorted(map(str, t.select(*plain.columns).collect()))
    assert ordered(cleaned) == ordered(plain)
    stands_for = {r["k"]: (r["raw_rows"], r["distinct_rows"]) for r in cleaned.collect()}
    assert stands_for == {"a": (9, 1), "b": (3, 1), "c": (6, 2), "d": (3, 1)}

    rows = {r["column"]: r for r in cleaning_audit(cleaned, df.columns, SPEC).collect()}
    found = {(c, k): r[k] for c, r in rows.items() for k in KINDS if r[k]}
    assert found == {
        ("kind", "placeholder"): 1, ("text", "placeholder"): 1, ("text", "rewritten"): 1, ("price", "negative"): 1, ("n", "negative"): 1,
        ("span", "negative"): 1, ("day", "unreadable"): 1, ("unit", "unit"): 1, ("gone", "rewritten"): 1, ("other", "placeholder"): 1,
    }
    assert rows["gone"]["role"] == "leakage" and rows["price"]["role"] == "transformed" and rows["day"]["cells_changed"] == 1
    assert {(r["exact_copies_dropped"], r["logical_copies_dropped"]) for r in rows.values()} == {(len(ROWS) * COPIES - 5, 1)}


def test_marks_of_a_wide_table_take_several_numbers(spark):
    from assayer.operators.audit import cleaning_audit, mark_names
    from assayer.plans.clean import clean

    wide = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame(ROWS[:1], SCHEMA).select("*", *[F.lit(" x " if i % 13 == 0 else "x").alias(c) for i, c in enumerate(wide)])
    assert len(mark_names(df.columns)) == 15
    rows = {r["column"]: r["rewritten"] for r in cleaning_audit(clean(df, SPEC, nfkc=False, track=True), df.columns, SPEC).collect()}
    assert [c for c in wide if rows[c]] == [c for i, c in enumerate(wide) if i % 13 == 0]
    nothing = cleaning_audit(clean(df.where(F.lit(False)), SPEC, nfkc=False, track=True), df.columns, SPEC).collect()
    assert len(nothing) == len(df.columns) and all(r["cells_changed"] == 0 and r["exact_copies_dropped"] == 0 for r in nothing)
