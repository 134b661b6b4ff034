"""Sources on written files, and streams on small inputs."""

import json
import zipfile
import pytest
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quaestio import session
from quaestio.sources.config import read_allow_list, read_catalogue, read_metrics
from quaestio.sources.documents import DocxDataSource, read_documents
from quaestio.streaming import study

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def _p(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_documents(spark, tmp_path):
    cell = "<w:tc>{}</w:tc>"
    table = f"<w:tbl><w:tr>{cell.format(_p('1'))}{cell.format(_p('A'))}</w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{_p('1')}</w:tc>{cell.format(_p('B'))}</w:tr></w:tbl>"
    _docx(tmp_path / "a.docx", _p("Título") + table + _p("") + _p("Fim"))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_text("um\n\ndois")
    rows = read_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5:], []).append((r.n, r.kind, r.text))
    assert sorted(by["a.docx"[-5:]])[-4:][0][1] in ("paragraph", "error")
    texts = {(r.kind, r.text) for r in rows}
    assert {("paragraph", "Título"), ("row", "1 | A"), ("row", "B"), ("paragraph", "Fim"), ("error", "unsupported format"), ("paragraph", "dois")} <= texts
    assert sum(r.kind == "error" for r in rows) == 2
    spark.dataSource.register(DocxDataSource)
    (tmp_path / "b.docx").unlink()
    assert [r.text for r in spark.read.format("docx").load(str(tmp_path)).orderBy("n").collect()] == ["Título", "1 | A", "B", "Fim"]


def test_config(spark, tmp_path):
    cat = {"A\\B//c.pdf": {"gabarito": "g.pdf", "confirmado": True, "evidencia": "x"}, "a/b/C.pdf": {"gabarito": "h.pdf"}, "d.pdf": {"gabarito": ""}, "e.pdf": {"gabarito": "g", "confirmado": True}}
    (tmp_path / "c.json").write_text(json.dumps(cat))
    got = sorted((r.caminho, r.defeito or "") for r in read_catalogue(spark, str(tmp_path / "c.json")).collect())
    assert got == [("a/b/c.pdf", "caminho_repetido"), ("a/b/c.pdf", "caminho_repetido"), ("d.pdf", "gabarito_ausente"), ("e.pdf", "confirmacao_sem_evidencia")]
    good = {"versao": 1, "permitir": True, "entradas": [{"chave": "k", "sha256": "a" * 64}]}
    for change, n in (({}, 1), ({"permitir": "true"}, 0), ({"versao": 2}, 0), ({"entradas": [{"chave": "k", "sha256": "zz"}]}, 0)):
        (tmp_path / "l.json").write_text(json.dumps(good | change))
        assert read_allow_list(spark, str(tmp_path / "l.json")).count() == n
    m = tmp_path / "m"
    m.mkdir()
    for k, x in enumerate([{"modo": "manual", "duracao": 30}, {"modo": "assistido", "duracao": 20, "espera": 5}, {"modo": "manual", "duracao": 9, "cancelada": True}]):
        (m / f"{k}.json").write_text(json.dumps(x))
    (m / "bad.json").write_text("{")
    assert sorted(r.duracao for r in read_metrics(spark, str(m)).collect()) == [20.0, 30.0]


def _events(spark, tmp_path, rows):
    spark.createDataFrame(rows, "chave long, n int, quando timestamp, correta boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("chave long, n int, quando timestamp, correta boolean").parquet(str(tmp_path / "in"))


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, k, t + timedelta(seconds=60 * k), True) for k in range(3)] + [(2, 0, t, False), (1, 9, t + timedelta(hours=5), False)]
    ev = _events(spark, tmp_path, rows)
    got = {r.chave: (r.intervalo_dias, r.fator_facilidade, r.acertos_seguidos) for r in _run(study.spaced_repetition(ev), "update", "sr")}
    assert got == {1: (1, 2.3, 0), 2: (1, 2.5, 0)}
    acc = {r.chave: (r.total, r.acertos) for r in _run(study.running_accuracy(ev), "complete", "acc")}
    assert acc == {1: (4, 3), 2: (1, 0)}
    assert len(_run(study.latest_progress(ev), "append", "lp")) == 5
    batch = study.study_sessions(spark.read.parquet(str(tmp_path / "in")))
    assert sorted((r.chave, r.n) for r in batch.collect()) == [(1, 1), (1, 3), (2, 1)]


def test_session_helpers(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert session.checkpoint(df).count() == 10 and session.materialize(df).columns == ["id", "k"]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True)))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        fake = N(sparkContext=N(_jsc=jsc, master=master), conf=N(get=lambda *_: None))
        with pytest.raises(RuntimeError):
            session.shared_dir(fake)
