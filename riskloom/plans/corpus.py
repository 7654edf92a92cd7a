"""Source trees derived from the event log, so that every rule has something to find.

An event becomes one line of a source file; the kind of line follows from the event id. A file is a
user's events of one period, whatever the size of the table, so a control is seen wherever it stands in the file.

Two layouts: `project` (a user is a project with two files) and `snapshot` (each week of a
user is a report of its own, and the file keeps its path from week to week).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

KINDS = 151
FIRST_DAY = "2024-01-01"

# Function names by kind of line; how a definition is written depends on the file type.
NAMES = {
    0: "issue_refund", 1: "deleteUserAccount", 2: "run_shell_job", 3: "sendEmailNow", 4: "query_customer_db",
    5: "get_customer_profile", 6: "list_documents_page", 7: "fetch_record_raw", 8: "writeFileAtomic",
    9: "firebase_write_doc", 10: "helper_value", 11: "adminPanel", 12: "read_internal_notes",
    13: "update_user_row", 14: "compute_total", 15: "crm_sync",
}
ASYNC_NAMES = {16: "execute_code_block", 17: "fetchUrlFast"}
# Other lines by kind; {e} is the event id.
LINES = {
    20: "row = mask_fields(row)", 21: "value = sanitize(value)", 22: "if not requires_approval(action): stop()",
    23: 'approval_status = "pending"', 24: "needs_review = True", 25: '  audit_log("tool", action)  ',
    26: "log_to_db(event)", 27: 'logger.info("done")', 28: "result = safe_call(action)", 29: "my_logger2 = make()",
    30: "approval_requiredish = 1", 31: "tools = [refund_tool, email_tool]", 32: 'graph.add_node("read_file", node)',
    33: "crew = Crew(agents=[admin_agent])", 34: '"type": "function", "name": "http_request"',
    35: "model.bind_tools([lookup])", 36: 'OPENAI_API_KEY = "sk-demo-{e}-value"', 37: 'JWT_SECRET = "jwt-demo-{e}-value"',
    38: 'DB_URL = "postgres://app:pw{e}@db.local/x"', 39: 'token = os.getenv("TOKEN")', 40: "result = delete_record(id)",
}


def _quoted(text: str) -> str:
    return " || ".join(f"'{part}'" if part != "{e}" else "event_id" for part in _pieces(text))


def _pieces(text: str) -> list[str]:
    if "{e}" not in text:
        return [text]
    before, after = text.split("{e}", 1)
    return [before, "{e}", after]


def kind_sql() -> str:
    return f"event_id % {KINDS}"


def extension_sql(layout: str) -> str:
    exts = [".py", ".ts", ".js", ".jsx", ".json", ".txt"]
    shift = "user_id + period" if layout == "project" else "user_id"
    whens = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(exts))
    return f"CASE ({shift}) % {len(exts)} {whens} END"


def path_sql(layout: str) -> str:
    if layout == "snapshot":
        return "CASE WHEN ext = '.txt' THEN 'prompts/base_prompt' ELSE 'src/main' END || ext"
    return "CASE WHEN ext = '.txt' THEN 'prompts/system_prompt_h' ELSE 'src/h' END || period || ext"


def report_sql() -> str:
    return "'u' || user_id || '-w' || period"


def line_sql() -> str:
    """The line of an event, for the columns event_id, kind, ext, props, user_id, line_no, last_no."""
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in NAMES.items())
    anames = " ".join(f"WHEN {k} THEN '{n}'" for k, n in ASYNC_NAMES.items())
    plain = f"CASE kind {names} END"
    later = f"CASE kind {anames} END"
    others = " ".join(f"WHEN kind = {k} THEN {_quoted(t)}" for k, t in LINES.items())
    item = (
        "CASE WHEN kind < 3 THEN '{\"k\": 1, \"profile\": [{\"eMail\": \"x\"}]}' "
        "WHEN kind < 5 THEN '{\"note\": \"password\", \"Phone\": ' || event_id || '}' ELSE props END"
    )
    close = "CASE WHEN line_no = last_no AND user_id % 5 <> 0 THEN ']' ELSE '' END"
    return f"""CASE
      WHEN ext = '.json' THEN CASE WHEN line_no = 1 THEN '[' ELSE ',' END || {item} || {close}
      WHEN kind <= {max(NAMES)} THEN CASE ext
        WHEN '.py' THEN 'def ' || {plain} || '(x):'
        WHEN '.ts' THEN 'function ' || {plain} || '(x) {{'
        ELSE 'const ' || {plain} || ' = (x) => {{' END
      WHEN kind <= {max(ASYNC_NAMES)} THEN CASE ext
        WHEN '.py' THEN 'async def ' || {later} || '(x):'
        WHEN '.ts' THEN 'export async function ' || {later} || '(x) {{'
        ELSE 'export const ' || {later} || ' = async x => {{' END
      {others}
      ELSE 'x' || kind || ' = step(' || kind || ')' END"""


def lines(spark: SparkSession, sf_dir: str, layout: str = "project") -> DataFrame:
    """lines(project_id, [report_id, period], path, line_no, line)."""
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    days = 15 if layout == "project" else 6
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "props", F.floor(day / days).cast("int").alias("period"),
        F.expr(kind_sql()).alias("kind"),
    )
    file = W.partitionBy("user_id", "period")
    numbered = (
        events.withColumn("line_no", F.row_number().over(file.orderBy("event_id")).cast("int"))
        .withColumn("last_no", F.count("*").over(file).cast("int"))
        .withColumn("ext", F.expr(extension_sql(layout)))
    )
    keys = [F.concat(F.lit("u"), "user_id").alias("project_id")]
    if layout == "snapshot":
        keys += [F.expr(report_sql()).alias("report_id"), "period"]
    return numbered.select(
        *keys, F.expr(path_sql(layout)).alias("path"), "line_no", F.expr(line_sql()).alias("line")
    )


def keys_of(layout: str) -> list[str]:
    return ["project_id"] if layout == "project" else ["report_id"]


def files(spark: SparkSession, sf_dir: str, layout: str = "project") -> DataFrame:
    """files(project_id | report_id, path, text): the lines of a file joined to its text."""
    return joined(lines(spark, sf_dir, layout), keys_of(layout))


def joined(line_table: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return line_table.groupBy(*keys, "path").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text")
    )


def units(spark: SparkSession, sf_dir: str, layout: str = "project") -> DataFrame:
    """Project or report ids, repeats included, straight from the event table."""
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if layout == "project":
        return events.select(F.concat(F.lit("u"), "user_id").alias("project_id"))
    return events.select(
        F.concat(F.lit("u"), "user_id", F.lit("-w"), F.floor(day / 6).cast("int")).alias("report_id")
    )


# Statements of the files made of documents, by length of a sentence modulo FLOWS: Python, then script. {i}: its number.
FLOWS = 23
FLOW_LINES = {
    0: ("def task_{i}(request, who: str = None):", "function task_{i}(request, who) {"),
    1: ("    order = parse(request)", "  const order = parse(request)"),
    2: ("    issue_refund(order)", "  issue_refund(order)"),
    3: ("    api.delete_user(id=who)  # who", "  api.deleteUser({id: who})  // who"),
    4: ("    order = 5", "  order = 5"),
    5: ("    order = sanitize(order)", "  order = sanitize(order)"),
    6: ("if ready:", "}"),
    7: ("    if order:", "  if (order) {"),
    8: ("        send_email(to=order.address)", "    sendEmail(order.address)"),
    9: ("    issue_refund('order', x.order)", "  issue_refund('order', x.order)"),
    10: ("    run_shell(f'rm {who}')", "  runShell(`rm ${who}`)"),
    11: ("    total += order", "  total += order"),
    12: ("    execute_code(total)", "  execute_code(total)"),
    13: ("    def inner_{i}(order):", "  const inner_{i} = async order => {"),
    14: ("", "}"),
    15: ("        issue_refund(order, total)", "  }"),
}


def flow_sql(number: str, kind: str, python: str) -> str:
    """The statement of a sentence from SQL for its number, its kind and whether the file is Python."""
    said = lambda t: " || ".join([_q(t.split("{i}")[0]), number, _q(t.split("{i}")[1])]) if "{i}" in t else _q(t)
    whens = " ".join(f"WHEN {k} THEN CASE WHEN {python} THEN {said(a)} ELSE {said(b)} END" for k, (a, b) in FLOW_LINES.items())
    return f"CASE {kind} {whens} ELSE '    x = step(' || {number} || ')' END"


def _q(text: str) -> str:
    # Parted, or SQL would read it as a variable of its own.
    return "'" + text.replace("'", "''").replace("${", "$' || '{") + "'"


def flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(project_id, path, text): every document as a source file with one statement for each sentence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "concat('d', doc_id) AS project_id", "CASE WHEN doc_id % 2 = 0 THEN 'src/flow.py' ELSE 'src/flow.ts' END AS path",
        "doc_id % 2 = 0 AS python", "split(coalesce(text, ''), '[.] ') AS parts")
    statement = flow_sql("CAST(i + 1 AS STRING)", f"length(part) % {FLOWS}", "python")
    return docs.selectExpr("project_id", "path", f"array_join(transform(parts, (part, i) -> {statement}), '\n') AS text")
