"""JSON configuration and metric files: read strictly, with defects as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<gabarito:string,cargo:string,prova:string,codigo:string,confirmado:boolean,evidencia:string>"
METRIC = "modo string, duracao double, espera double, cancelada boolean"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(caminho, gabarito, cargo, ..., defeito) of a catalogue {path: entry}.

    Paths are normalized; one that several entries share is a defect of each, so is a missing key file
    or a confirmation without evidence.
    """
    text = spark.read.text(path, wholetext=True)
    e = text.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{ENTRY}>"))).alias("e"))
    p = F.lower(F.regexp_replace(F.translate(F.trim("e.key"), "\\", "/"), "/+", "/"))
    rows = e.select(p.alias("caminho"), "e.value.*")
    n = rows.groupBy("caminho").agg(F.count("*").alias("_n"))
    defect = (
        F.when(F.col("_n") > 1, "caminho_repetido")
        .when(F.trim(F.coalesce("gabarito", F.lit(""))) == "", "gabarito_ausente")
        .when(F.coalesce("confirmado", F.lit(False)) & (F.trim(F.coalesce("evidencia", F.lit(""))) == ""), "confirmacao_sem_evidencia")
    )
    return rows.join(n, "caminho").withColumn("defeito", defect).drop("_n")


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """(chave, sha256) of an allow-list, fail-closed: any defect anywhere gives no rows at all."""
    kind = "struct<versao:string,permitir:string,entradas:array<struct<chave:string,sha256:string>>>"
    # read as text, so that "true" in quotes is told from true
    raw = spark.read.text(path, wholetext=True).select("value", F.from_json("value", kind).alias("l"))
    literal = F.col("value").rlike(r'"permitir"\s*:\s*true\b') & F.col("value").rlike(r'"versao"\s*:\s*1\b')
    good = F.forall("l.entradas", lambda x: x["chave"].isNotNull() & F.coalesce(x["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)))
    ok = raw.where(literal & F.coalesce(good, F.lit(False)))
    return ok.select(F.explode("l.entradas").alias("x")).select("x.chave", "x.sha256")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Session metrics of a folder of JSON files; broken files, cancelled sessions and impossible times are left out."""
    df = spark.read.schema(METRIC).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    return df.where("modo IN ('manual', 'assistido') AND NOT coalesce(cancelada, false) AND duracao > 0 AND coalesce(espera, 0) BETWEEN 0 AND duracao")
