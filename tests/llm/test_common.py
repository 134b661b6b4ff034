"""What every operator must survive: empty tables, nulls, empty and very long texts, repeated rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quaestio.llm import registry
from tests.llm.helpers import LONG, bank
from tests.test_oracles import DATA, plain


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return bank(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    text = "Quando a banca revisora examinou o parecer ambiental em março, o fiscal de obras ordenou a vacina exigível e o estagiário anulou a tabela regional sem observar o prazo."
    questions = [(None, text, None, None, None, None, None), (1, None, None, None, None, None, None), (2, "", "", "", "", "", ""), (3, "   ", " ", " ", " ", " ", None)]
    questions += [(k, text, text, "Direito", "Banca", "Cargo", "multipla_escolha") for k in (4, 5, 5, 6)] + [(7, LONG, LONG, LONG[:5000], "x" * 9000, "\n", "certo_errado")]
    options = [(None, None, None, None), (1, 4, "A", ""), (2, 4, "B", None), (3, 4, "C", text), (3, 4, "C", text), (4, 99, "D", LONG)]
    docs = [(None, text, "a"), (1, None, "a"), (2, "", "a"), (3, text, None), (4, text, "a"), (4, text, "a"), (5, LONG, "b"), (6, "a" * 300_000, "b"), (7, "é" * 1000, "nowhere")]
    raw = [(None, None, None), (1, None, None), (2, "f", ""), (3, "f", "[1]"), (4, "f", "{bad"), (5, "f", '{"a": null}'), (6, "f", '{"A": ""}'), (7, "f", '{"a": {"b": [1, 2]}}')]
    return bank(
        spark, tmp_path_factory.mktemp("odd"), questoes=questions, alternativas=options, documents=docs, importacoes_brutas=raw,
        itens_avaliacao=[(None, text), (1, None), (2, ""), (3, text), (4, text), (5, LONG)],
        lista_canonica=[(None, None, None, None), (1, "banca", "Banca Geral", "BG"), (2, "banca", None, None), (3, "disciplina", "", None), (4, "disciplina", "Direito Civil", None)],
        metas_mistura=[("a", 0.5, 2), ("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 0), (None, 0.1, 1), ("d", None, 1)],
        provas_cadastradas=[(1, None), (2, 5)], prova_cadastrada_questoes=[(1, 4, 1), (2, 5, 1), (None, None, None)],
    )


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty(spark, empty, name):
    df = registry.queries()[name](spark, empty)
    assert df.columns and df.count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd(spark, odd, name):
    registry.queries()[name](spark, odd).collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    ours, theirs = plain(registry.queries()[name](spark, DATA).toPandas()), plain(con.execute(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_on_data(spark, name):
    registry.queries()[name](spark, DATA).collect()
