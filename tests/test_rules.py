"""Rule cases: what is found, at which severity, and where the windows end."""

import pytest

from riskloom.operators import scan as S


def pad(n, line="x = 1"):
    return [line] * n


def text(*lines):
    return "\n".join(lines)


def near(word, distance, definition="def issue_refund(x):"):
    return text(definition, *pad(distance - 1), word)


CASES = {
    "critical": {"a.py": "def issue_refund(x):"},
    "mixed_case": {"a.py": "def ProcessRefund(order):"},
    "both_tiers": {"a.py": "def customer_refund(x):"},
    "high": {"a.py": "async def sendEmail(x):"},
    "call": {"a.py": "result = delete_record(id)"},
    "arrow": {"a.js": "const deleteItem = (id) => {};"},
    "arrow_one": {"a.tsx": "export const deleteItem = async id => id"},
    "js_function": {"a.jsx": "export async function deleteItem(id) {"},
    "py_in_js": {"a.js": "def delete_item(id):"},
    "unicode": {"a.py": "def ñrefund_日本(x):"},
    "not_code": {"a.md": "def issue_refund(x):"},
    "upper_ext": {"A.PY": "def issue_refund(x):"},
    "crlf": {"a.py": "x = 1\r\n\r\ndef issue_refund(x):\r\n"},
    "odd_breaks": {"a.py": "x\x0by def issue_refund(x):"},
    "approval_15": {"a.py": near("approval_required", 15)},
    "approval_16": {"a.py": near("approval_required", 16)},
    "approval_inside": {"a.py": near("approval_requiredish", 3)},
    "audit_15": {"a.py": near("LOGGER", 15)},
    "audit_16": {"a.py": near("logger", 16)},
    "audit_inside": {"a.py": near("my_logger", 3)},
    "both": {"a.py": text("def issue_refund(x):", "audit_log(1)", "needs_review")},
    "wrapper": {"a.py": near("safe_call(x)", 15)},
    "wrapper_16": {"a.py": near("safe_call(x)", 16)},
    "high_partial": {"a.py": near("trace_id", 2, "def send_email(x):")},
    "gate_10": {"a.py": near("approved_by", 10)},
    "gate_11": {"a.py": near("approved_by", 11)},
    "gate_before": {"a.py": text("APPROVAL_STATUS", *pad(9), "def issue_refund(x):")},
    "trail_15": {"a.py": near("log_to_db(x)", 15)},
    "trail_16": {"a.py": near("log_to_db(x)", 16)},
    "mask_10": {"a.py": near("mask_fields", 10, "def get_record(x):")},
    "mask_11": {"a.py": near("mask_fields", 11, "def get_record(x):")},
    "data_plain": {"a.py": "def list_documents(x):"},
    "data_camel": {"a.py": "def listDocuments(x):"},
    "json_two": {"c.json": '{"a": [1, {"EMAIL": 1}, [{"phone": 2}]]}'},
    "json_bad": {"c.json": "{bad email"},
    "json_none": {"c.json": '{"note": "email"}'},
    "json_escaped": {"c.json": '{"\\u0065mail": 1}'},
    "json_repeat": {"c.json": '{"email": 1, "email": 2}'},
    "framework": {"a.py": "llm.bind_tools([send_email, issue_refund])"},
    "framework_12": {"a.py": text("llm.bind_tools([issue_refund])", *pad(11), "manual_review")},
    "framework_13": {"a.py": text("llm.bind_tools([issue_refund])", *pad(12), "manual_review")},
    "framework_order": {"a.ts": "tools = [fetch_url]"},
    "openai": {"a.ts": '{ "type" : "function", "name": "read_file" }'},
    "graph": {"a.py": "g.add_node('shell')"},
    "crew": {"a.py": "crew = CREW(x, admin)"},
    "no_risk": {"a.py": "llm.bind_tools([lookup])"},
    "secrets": {"config.py": text('GEMINI_API_KEY = "AIzaSyDUMMY_EXPOSED_KEY"', 'JWT_SECRET = "demo_super_secret"',
                                  'DB = "postgres://u:pw@host/db"', 'K = os.getenv("API_KEY")', 'key = "sk-abcdefghijklmnop1234"')},
    "secret_any_file": {"notes.yml": 'token: "0123456789abcdef"'},
    "prompt_file": {"prompts/system_prompt.txt": "You are", "prompt.py": "x", "empty_prompt.md": "  \n"},
    "nothing": {"a.py": ""},
}


@pytest.fixture(scope="module")
def found(files_of):
    rows = S.with_texts(S.scan(files_of(CASES))).collect()
    out = {name: [] for name in CASES}
    for r in sorted(rows, key=lambda r: (r.stage, r.path, r.line_no, r.sub_ord)):
        out[r.project_id].append(r)
    return out


def short(rows, rule):
    return [(r.line_no, r.severity) for r in rows if r.rule == rule]


@pytest.mark.parametrize("case,rule,expected", [
    ("critical", "tool", [(1, "Critical")]), ("mixed_case", "tool", [(1, "Critical")]), ("both_tiers", "tool", [(1, "Critical")]),
    ("high", "tool", [(1, "High")]), ("call", "tool", []), ("arrow", "tool", [(1, "Critical")]), ("arrow_one", "tool", [(1, "Critical")]),
    ("js_function", "tool", [(1, "Critical")]), ("py_in_js", "tool", []), ("unicode", "tool", [(1, "Critical")]),
    ("not_code", "tool", []), ("upper_ext", "tool", [(1, "Critical")]), ("crlf", "tool", [(3, "Critical")]), ("odd_breaks", "tool", [(3, "Critical")]),
    ("approval_15", "tool", [(1, "Medium")]), ("approval_16", "tool", [(1, "Critical")]), ("approval_inside", "tool", [(1, "Critical")]),
    ("approval_inside", "approval", []), ("audit_15", "tool", [(1, "Medium")]), ("audit_16", "tool", [(1, "Critical")]),
    ("audit_inside", "tool", [(1, "Critical")]), ("audit_inside", "audit", []), ("both", "tool", []), ("wrapper", "tool", []),
    ("wrapper_16", "tool", [(1, "Critical")]), ("high_partial", "tool", [(1, "Low")]), ("high_partial", "approval", [(1, "Low")]),
    ("gate_10", "approval", []), ("gate_11", "approval", [(1, "Critical")]), ("gate_before", "approval", []),
    ("trail_15", "audit", []), ("trail_16", "audit", [(1, "High")]), ("critical", "audit", [(1, "High")]), ("high", "audit", [(1, "Medium")]),
    ("approval_15", "audit", [(1, "Medium")]), ("mask_10", "data", []), ("mask_11", "data", [(1, "High")]), ("data_plain", "data", [(1, "High")]),
    ("data_camel", "data", []), ("json_two", "json", [(1, "Medium")]), ("json_bad", "json", []), ("json_none", "json", []),
    ("json_escaped", "json", [(1, "Medium")]), ("json_repeat", "json", [(1, "Medium")]), ("framework", "framework", [(1, "High")]),
    ("framework_12", "framework", []), ("framework_13", "framework", [(1, "High")]), ("framework_order", "framework", [(1, "Medium")]),
    ("openai", "framework", [(1, "Medium")]), ("graph", "framework", [(1, "High")]), ("crew", "framework", [(1, "High")]),
    ("no_risk", "framework", []), ("secrets", "secret", [(1, "Critical"), (2, "High"), (3, "High"), (5, "Critical")]),
    ("secret_any_file", "secret", [(1, "High")]), ("prompt_file", "prompt", [(1, "Medium")]), ("nothing", "tool", []),
])
def test_case(found, case, rule, expected):
    assert short(found[case], rule) == expected


def test_titles(found):
    assert [r.title for r in found["secrets"]][:2] == ["Hardcoded GEMINI_API_KEY detected", "Hardcoded JWT_SECRET detected"]
    assert found["framework_order"][0].title.endswith("LangChain")
    assert found["openai"][0].title.endswith("OpenAI tools")
    assert "'email', 'phone'" in found["json_two"][0].why_it_matters
    assert "partial mitigation" in found["approval_15"][0].why_it_matters
    assert found["critical"][1].title == "No human approval gate found near 'Risky function 'issue_refund' detected'"


def test_sample_shape(files_of, spark):
    """A project of the shape of the vulnerable sample reaches the worked-out scores."""
    from riskloom.operators import score

    tools = text(
        "def get_customer_record(user_id):", *pad(10), "", "def read_internal_policy():", "    return 1", "", "",
        "def issue_refund(user_id, amount):", "    # no approval_required, no human_review, no confirm_action.",
        *pad(6), "", "def send_email(a, b):", "    return 1")
    tree = {"tools.py": tools, "data.json": '{"customers": [{"email": "x"}]}', "system_prompt.txt": "You are",
            "config.py": 'GEMINI_API_KEY = "AIzaSyDUMMY_EXPOSED_KEY"\nJWT_SECRET = "demo_super_secret"'}
    files = files_of({"p": tree})
    row = score.scored(score.facts(S.scan(files), files)).collect()[0]
    assert (row.score_tool_permission, row.score_human_approval, row.score_data_exposure, row.score_auditability) == (45, 25, 65, 45)
    assert (row.score_secret_exposure, row.score_prompt_injection) == (65, 15)
    assert row.safety_score == 60
    assert (row.n_critical, row.n_high, row.n_medium, row.n_low) == (1, 5, 6, 1)
