"""Input that reaches a privileged call, case by case."""

import pytest

from riskloom.operators.reach import input_reaches_action
from riskloom.operators.scan import with_texts

PY = {
    "def f(a):\n    issue_refund(a)\n": [(2, 1)],
    "def f(a):\n    issue_refund(b)\n": [],
    "def f(a):\n    pass\nissue_refund(a)\n": [],
    "def f(a):\n\n# note\n    b = load(a)\n    c = [b]\n    issue_refund(c)\n": [(6, 1)],
    "def f(a):\n    a = 1\n    issue_refund(a)\n": [],
    "def f(a):\n    a += 1\n    issue_refund(a)\n": [(3, 1)],
    "def f(a):\n    a = sanitize(a)\n    issue_refund(a)\n": [],
    "def f(a):\n    issue_refund('a', \"a\", x.a, a=1)  # a\n": [],
    "def f(a):\n    run_shell(f'rm {a}', 'b')\n": [(2, 1)],
    "def f(a, *, b: Dict[str, int] = None):\n\tself.api.delete_user(id=b)\n": [(2, 1)],
    "def f(self, x):\n    issue_refund(self)\n": [],
    "def f(a):\n    def g(b):\n        issue_refund(a, b)\n    issue_refund(b)\n    issue_refund(a)\n": [(3, 1), (3, 2), (5, 1)],
    "def f(a):\n    return log(issue_refund(a))\n": [(2, 1)],
    "def f(a):\n    if a == 1:\n        issue_refund(a)\n": [(3, 1)],
    "async def f(a):\n    await Send_Email(to=a.address)\n": [(2, 1)],
    "": [], "def f(a):": [], "\n\n": [],
}
TS = {
    "function f(a) {\n  issueRefund(a)\n}\nissueRefund(a)\n": [(2, 1)],
    "const f = async a => {\nconst b = {x: a}\nif (b) {\nissueRefund(b)\n}\nissueRefund(b)\n}\nissueRefund(b)": [(4, 1), (6, 1)],
    "function f(a)\n{\n  runShell(`rm ${a}`)\n}\n": [(3, 1)],
    "function f(a) {\n  issueRefund('}', \"a\") // a\n  issueRefund(a)\n}\n": [(3, 1)],
    "const f = ({a, b}) => {\n  issueRefund(b)\n}": [(2, 1)],
}


@pytest.fixture(scope="module")
def found(spark, files_of):
    trees = {f"{ext}{i}": {f"x.{ext}": text} for ext, cases in (("py", PY), ("ts", TS)) for i, text in enumerate(cases)}
    trees["md"] = {"x.md": "def f(a):\n    issue_refund(a)\n"}
    out = {}
    for r in input_reaches_action(files_of(trees).unionByName(spark.createDataFrame([("none", "x.py", None)], "project_id string, path string, text string"))).collect():
        out.setdefault(r["project_id"], []).append((r["line_no"], r["input_line"]))
    return out


@pytest.mark.parametrize("case", range(len(PY)))
def test_python(found, case):
    assert sorted(found.get(f"py{case}", [])) == list(PY.values())[case], list(PY)[case]


@pytest.mark.parametrize("case", range(len(TS)))
def test_script(found, case):
    assert sorted(found.get(f"ts{case}", [])) == list(TS.values())[case], list(TS)[case]


def test_nothing_else_is_found(found):
    assert not {"md", "none"} & set(found)


def test_texts(files_of):
    row = with_texts(input_reaches_action(files_of({"p": {"a.py": "def handle(order):\n  issue_refund(order)"}}))).collect()[0]
    assert (row["severity"], row["category"], row["evidence"]) == ("Critical", "Prompt Injection Risk", "issue_refund(order)")
    assert row["title"] == "Input of 'handle' reaches privileged call 'issue_refund'"
    assert "handle" in row["why_it_matters"] and "issue_refund" in row["suggested_fix"]


def test_long_file_with_many_functions(files_of):
    text = "\n".join(f"def f{i}(a):\n    b = a\n    issue_refund(b)\n    issue_refund(c)" for i in range(3000))
    assert input_reaches_action(files_of({"p": {"a.py": text}})).count() == 3000
