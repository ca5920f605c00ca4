"""Text, numbers, derivations, dedup, cleaning and scoring on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer import procurement_spec
from assayer.functions import numbers as N
from assayer.functions import text as X
from assayer.operators import dedup
from assayer.operators.columns import normalize_columns
from assayer.operators.lookups import holm, sample_rows
from assayer.plans.clean import clean
from assayer.plans.score import score
from assayer.sources.scan import enforce_contract
from assayer.workload.fixtures import SPEC, duplicated, processes

SF = "/root/testdata/sf0.001"


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(function(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_normalize_text(spark):
    got = apply(spark, X.normalize_text, "  a\t b  c ", " x y\x1f", "   ", None, "é  é")
    assert got == ["a b c", "x y", None, None, "é é"]


def test_compatibility_forms(spark):
    assert apply(spark, lambda c: X.normalize_text(c, nfkc=True), "ﬁn", "Ｎ／Ａ", "plain", None) == ["fin", "N/A", "plain", None]
    assert apply(spark, lambda c: X.normalize_token(c, nfkc=True), "Ｎ／Ａ", "Ñandú ß") == ["n/a", "nandu"]


def test_normalize_token(spark):
    assert apply(spark, X.normalize_token, " No  DEFINIDO ", "Año(s)", "ß", None) == ["no definido", "ano(s)", None, None]


def test_canonicalize(spark):
    values = ("N/A", "No Aplica", "No especificado", " Bogotá  D.C. ", "no adjudicado", "")
    assert apply(spark, X.canonicalize_text, *values) == [None, None, None, "Bogotá D.C.", None, None]
    kept = apply(spark, lambda c: X.canonicalize_text(c, True, True, "?"), *values)
    assert kept == ["?", "NO_APLICA", "UNIDAD_DESCONOCIDA", "Bogotá D.C.", "?", None]


def test_units_multivalue_and_placeholder(spark):
    assert apply(spark, X.duration_unit, "DÍAS", "meses", "no aplica", "siglo", None) == ["día(s)", "Mes(es)", "NO_APLICA", "UNIDAD_DESCONOCIDA", None]
    assert apply(spark, X.unit_days, "Año(s)", "horas", "siglo") == [365.0, pytest.approx(1 / 24), None]
    assert apply(spark, X.multivalue_text, "[b, a, b, ]", "x", "[]", None) == ["b, a", "x", None, None]
    assert apply(spark, X.non_placeholder, "Sin  informacion", "no definida", "obra", None, " ") == [False, False, True, False, False]


def test_numbers(spark):
    assert apply(spark, N.to_number, "1d", "NaN", "-1.5e2", " 7 ", "1,2") == [None, None, -150.0, 7.0, None]
    assert apply(spark, lambda c: N.to_number(c, True), "$1,200", "5%") == [1200.0, 5.0]
    day = spark.createDataFrame([(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 23))], "a timestamp, b timestamp")
    assert day.select(N.whole_days(F.col("a"), F.col("b"))).first()[0] == -1


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["Código  (Único)", "__A-b__"])
    assert normalize_columns(df).columns == ["codigo_unico", "a_b"]


def test_contract_names_missing_columns(spark):
    with pytest.raises(ValueError, match="zzz"):
        enforce_contract(spark.range(1), ["id", "zzz"])


def test_exact_dedup_with_a_hot_group(spark):
    df = spark.range(900).select((F.col("id") % 300 + F.when(F.col("id") < 600, 0).otherwise(1)).alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise("x").alias("b"))
    df = df.unionByName(spark.range(500).select(F.lit(-1).cast("long").alias("a"), F.lit("h").alias("b")))
    kept = dedup.drop_exact(df)
    assert kept.count() == df.distinct().count()
    assert kept.filter("a = -1").collect()[0]["was_exact_duplicate"] is True


def test_logical_dedup_prefers_complete_then_latest_then_tie(spark):
    rows = [("k", None, 5, 1), ("k", "x", 3, 2), ("k", "x", 4, 3), ("k", "y", 4, 4), (None, "n", 1, 5), (None, "m", 2, 6), ("s", None, None, 7)]
    df = spark.createDataFrame(rows, "id string, t string, d int, tie int")
    for parts in (1, 5):
        best = dedup.drop_logical(df.repartition(parts), "id", ["t"], "d", ["tie"]).collect()
        assert {(r["id"], r["tie"], r["was_logical_duplicate"]) for r in best} == {("k", 4, True), (None, 6, True), ("s", 7, False)}


def test_cleaning_restores_the_original_rows(spark):
    cleaned = clean(duplicated(spark, SF), SPEC)
    originals = processes(spark, SF, "proc_id")
    assert cleaned.count() == originals.count()
    assert cleaned.select("proc_id").exceptAll(originals).count() == 0
    assert not set(SPEC.dropped) & set(cleaned.columns)


def test_rows_equal_after_correction_are_exact_copies(spark):
    rows = processes(spark, SF).filter("proc_key = 97").withColumn("base_price", F.lit(-3.0))
    cleaned = clean(rows.unionByName(rows.withColumn("base_price", F.lit(None).cast("double"))), SPEC).collect()
    assert len(cleaned) == 1 and cleaned[0]["was_exact_duplicate"] and not cleaned[0]["was_logical_duplicate"]


def test_scores_do_not_depend_on_partitioning(spark):
    rows = processes(spark, SF)
    columns = ["proc_id", "quality_score", "risk_level", "label_confidence"]
    one, many = (score(rows.repartition(n), SPEC).select(*columns).orderBy("proc_id").collect() for n in (1, 9))
    assert one == many


def test_preset_end_to_end(spark):
    spec = procurement_spec("community\\.example\\.org")
    base = {c: None for c in spec.required()}
    row = {
        **base, "id_del_proceso": "CO1.REQ.1", "referencia_del_proceso": "LP-001-2024", "id_del_portafolio": "CO1.BDOS.9",
        "urlproceso": '{"url": "https://community.example.org/Public/Tendering/OpportunityDetail/Index?noticeUID=CO1.NTC.1"}',
        "descripci_n_del_procedimiento": "Construcción  de una  escuela rural", "codigo_principal_de_categoria": "V1.72", "precio_base": "1500000",
        "departamento_entidad": "Antioquia", "ciudad_entidad": "Medellín", "modalidad_de_contratacion": "Licitación", "tipo_de_contrato": "Obra",
        "fecha_de_publicacion_del": "2024-01-01T00:00:00", "fecha_de_recepcion_de": "2024-01-20T10:00:00", "fecha_de_apertura_de_respuesta": "2024-01-21T00:00:00",
        "fecha_de_apertura_efectiva": "2024-01-21T00:00:00", "fecha_de_ultima_publicaci": "2024-01-01T00:00:00",
        "respuestas_al_procedimiento": "3", "respuestas_externas": "0", "conteo_de_respuestas_a_ofertas": "3", "proveedores_con_invitacion": "10",
        "proveedores_unicos_con": "3", "proveedores_invitados": "10", "duracion": "6", "unidad_de_duracion": "Mes(es)", "categorias_adicionales": "No Definido",
    }
    worse = {**row, "id_del_proceso": "CO1.REQ.2", "urlproceso": "n/a", "precio_base": "-5", "fecha_de_recepcion_de": "2023-12-31T23:00:00"}
    schema = ", ".join(f"{c} string" for c in row)
    df = spark.createDataFrame([tuple(r.values()) for r in (row, row, worse)], schema)
    scored = {r["id_del_proceso"]: r for r in score(clean(df, spec), spec).collect()}
    good, bad = scored["CO1.REQ.1"], scored["CO1.REQ.2"]
    assert good["was_exact_duplicate"] and good["duplicate_penalty"] == 1
    assert good["score_completeness"] == pytest.approx(1.0) and good["score_traceability"] == pytest.approx(0.65)
    assert good["score_temporal"] == pytest.approx(1.0) and good["duration_days"] == 180.0
    assert bad["precio_base"] is None and bad["temporal_anomaly"] and bad["flag_has_price"] == 0
    assert bad["quality_score"] < good["quality_score"]


def test_holm(spark):
    rows = [("f", 0.01), ("f", 0.04), ("f", 0.03), ("g", 0.5)]
    adjusted = {(r[0], r[1]): r["holm_adjusted_p_value"] for r in holm(spark.createDataFrame(rows, "f string, p double"), "p", ["f"]).collect()}
    assert adjusted == pytest.approx({("f", 0.01): 0.03, ("f", 0.03): 0.06, ("f", 0.04): 0.06, ("g", 0.5): 0.5})


def test_sample_is_reproducible_and_proportional(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4999, "mid").otherwise("one"))
    first = sample_rows(df.repartition(3), 500, ["id"], "s")
    second = sample_rows(df.repartition(8), 500, ["id"], "s")
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0
    assert {r["s"]: r["count"] for r in first.groupBy("s").count().collect()} == {"big": 400, "mid": 100, "one": 1}
    assert sample_rows(df, 10_000, ["id"]).count() == 5000


def test_white_space_of_any_kind_is_stripped(spark):
    from assayer.functions import numbers as N
    from assayer.functions import text as X
    from assayer.operators import columns as C
    from assayer.operators import profile as A

    df = spark.createDataFrame([("\tN/A\n",), ("\t\n",), ("\u00a0N/A",), ("\t12\n",), (" real \u3000",)], "t string")
    got = [tuple(r) for r in df.select(X.non_placeholder(F.col("t")), X.text_length(F.col("t")), N.to_number(F.col("t"))).collect()]
    assert got == [(False, 3, None), (False, 0, None), (False, 3, None), (True, 2, 12.0), (True, 4, None)]
    assert A.text_quality(df, ["t"]).first()["blank_pct"] == 20.0
    codes = spark.createDataFrame([("7021", "2024-01-02"), ("8905", "2024-01-03 10:00:00")], "code string, day string")
    assert {r["column"]: r["is_candidate"] for r in C.date_candidates(codes).collect()} == {"code": False, "day": True}


def test_describe_plan(spark):
    from assayer.plans.describe import describe
    from assayer.workload.fixtures import SPEC, processes

    rows = processes(spark, "/root/testdata/sf0.001")
    found = describe(rows, SPEC, entities=["nation"])
    assert {"overview", "inventory", "numeric_profile", "categorical_profile", "datetime_profile", "text_quality", "price_by_segment", "state_by_mode", "entities_by_nation"} <= set(found)
    assert found["overview"].first()["n_rows"] == rows.count()
    assert found["inventory"].count() == len(rows.columns)
    assert all(frame.columns for frame in found.values())


def test_key_sets_in_one_scan(spark):
    """Nulls that are there count apart from columns a set leaves out; the plan reads the table once."""
    from assayer.operators.dedup import duplicate_summary

    rows = [(1, None), (1, None), (None, 2), (None, 2), (None, None), (3, 3), (1, 5)]
    df = spark.createDataFrame(rows, "a int, b int")
    keys = [["a"], ["b"], ["b", "a"], ["a", "b"]]

    def plain(key, null_keys):
        held = [tuple(r["ab".index(c)] for c in key) for r in rows]
        held = [k for k in held if null_keys or None not in k]
        n = [held.count(k) for k in set(held) if held.count(k) > 1]
        return sum(n), len(n), round(100 * sum(n) / len(rows), 4)

    for null_keys in (True, False):
        got = {r[0]: tuple(r[1:]) for r in duplicate_summary(df, keys, null_keys).collect()}
        assert got == {", ".join(k): plain(k, null_keys) for k in keys}
    assert [tuple(r) for r in duplicate_summary(df.limit(0), [["a"]]).collect()] == [("a", 0, 0, 0.0)]


def test_places_by_ranges(spark):
    from assayer.operators.kernels import numbered

    df = spark.createDataFrame([(i * 7919 % 500, "x") for i in range(500)], "v int, w string").repartition(4)
    assert all(r["rank"] == r["v"] + 1 for r in numbered(df, ["v"], range_rows=60).collect())
