from pyspark.sql import functions as F

from tremolo.operators import model


def test_answers_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([("inner", ["RMS rose"], [("inner", 0.5, "consistent"), ("outer", 0.4, "conflict")], ["https://a.org/x"])], "conclusion string, evidence array<string>, candidates array<struct<fault_type:string,score:double,state:string>>, sources array<string>")
    assert model.reworded(rows, None).first().mode == "template"
    answers = {
        '```json\n{"fault_type": "outer", "summary": "see https://a.org/x/1"}\n```': ("model", "outer"), '{"fault_type": "cage", "summary": "no"}': ("template_fallback", "inner"),
        '{"fault_type": "outer", "summary": "see https://b.org"}': ("template_fallback", "inner"), "timeout": ("template_fallback", "inner"), '{"fault_type": "unconfirmed"}': ("model", "unconfirmed"),
    }
    for text, want in answers.items():
        r = model.reworded(rows, lambda p, t=text: F.lit(t)).first()
        assert (r.mode, r.conclusion) == want, text
    assert "inner (score 0.5000, clauses consistent)" in rows.select(model.prompt()).first()[0]
    (tmp_path / "env").write_text("# c\nA=1\nB='x'\nbad\n")
    assert model.load_settings(str(tmp_path / "env"), {"A": "2"}) == {"A": "2", "B": "x"}
