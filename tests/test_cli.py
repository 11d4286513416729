import json

from trestle.cli import main

RULES = '''
from trestle.operators import conditions as c
from trestle.plans.rule import rule
from pyspark.sql import functions as F

def rules(spark):
    df = spark.createDataFrame([("a", 3), ("b", 9)], "name string, cc int")
    return [rule(df, "calm").should(c.at_most("branches", F.col("cc"), 5, c.Elements("name", None, None))).stamped(rule_id="calm", because="it matters")]
'''


def test_commands(spark, tmp_path, capsys):
    rules, bad, base = str(tmp_path / "r.py"), str(tmp_path / "bad.py"), str(tmp_path / "base.json")
    (tmp_path / "r.py").write_text(RULES)
    (tmp_path / "bad.py").write_text("raise ValueError('no')")
    assert main(["check", rules, "--format", "json"], spark) == 1
    assert [v["element"] for v in json.loads(capsys.readouterr().out)["violations"]] == ["b"]
    assert main(["baseline", rules, "--baseline", base], spark) == 0
    assert main(["check", rules, "--baseline", base, "--format", "plain"], spark) == 0
    capsys.readouterr()
    assert main(["check", rules, bad, "--baseline", base, "--format", "plain"], spark) == 1 and "ValueError: no" in capsys.readouterr().out
    assert main(["explain", rules], spark) == 0 and "at most 5 branches" in capsys.readouterr().out
    assert main(["doctor", rules], spark) == 0 and main(["check"], spark) == 1
    assert main(["init", str(tmp_path / "new.py")]) == 0 and main(["init", str(tmp_path / "new.py")]) == 1
