"""Tables for the operators' tests, with further columns whose names clash with internal ones."""

LONG = "Palavra número um, " * 30_000
CLASH = {"w": 1, "token": "x", "rep": 2, "k1": 3, "stem": "s", "chave": "c", "n": 4, "_b": 5, "share": 0.5, "tokens": 6, "texto": None, "normal": "y", "t": "z"}


def write(spark, folder, name, rows, schema, clash=True):
    df = spark.createDataFrame(rows, schema)
    for c, v in CLASH.items() if clash else ():
        if c not in df.columns:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit(v))
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


Q = "id long, enunciado string, texto_apoio string, disciplina string, banca string, cargo string, tipo string"
A = "id long, questao_id long, letra string, texto string"
D = "doc_id long, text string, source string"
I = "registro_id long, arquivo string, registro string"  # noqa: E741
V = "item_id long, texto string"
L = "ref_id long, campo string, nome string, sigla string"
M = "source string, parcela_alvo double, max_repeticoes int"
P = "id long, documento_fonte_questoes_id long"
B = "prova_cadastrada_id long, questao_id long, ordem int"
SCHEMAS = {"questoes": Q, "alternativas": A, "documents": D, "importacoes_brutas": I, "itens_avaliacao": V, "lista_canonica": L, "metas_mistura": M, "provas_cadastradas": P, "prova_cadastrada_questoes": B}


def bank(spark, folder, **rows):
    """All tables; those not given are empty."""
    for name, schema in SCHEMAS.items():
        write(spark, folder, name, rows.get(name, []), schema)
    return str(folder)
