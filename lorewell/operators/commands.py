"""Results of commands as facts: what a command was about, whether it failed, verified, changed or reported something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as tx
from lorewell.operators.fact_rules import SECRET
from lorewell.operators.facts import kept, let, one_line, plain, truncated
from lorewell.operators.sessions import matches
from lorewell.sources.tables import dealt

# Fixed values, as patterns of any case. What is never told: long, nested or secret commands, and looking around.
MOST_COMMAND, MOST_JOINTS, MOST_RESULT = 260, 3, 140
HIDDEN = (r"\n|<<|\bbase64\b|\b(?:\.env|id_rsa|credentials?)\b", SECRET)
LOOKING = (r"^(?:pwd|ls(?:\s|$)|find(?:\s|$)|git\s+status(?:\s|$))", r"^ip\s+-br\s+(?:link|addr|a)(?:\s+show)?\s*$", r"\s--version(?:\s|$)|^(?:\S+\s+)?--version(?:\s|$)", r"^grep\b")
POINTLESS = ((r"^sudo\s+-n\b", r"password (?:is )?required"), (r"^timeout\b", r"^(?:ok|success)$"))
BABBLE = r"^(?:progress|debug|trace|npm warn|download(?:ing)?|\d+%)\b"
# What a command does, and what its output says.
CHANGING = r"\b(?:restart|start|stop|enable|disable|install|remove|purge|update|upgrade|apply|create|delete|write|set|replace|mv|cp|tee|sed\s+-i|docker\s+compose\s+up)\b|(?:^|\s)(?:>|>>)\s*\S+"
CHECKING = r"\b(?:is-active|status|show|check|test|verify|ss\s|netstat|lsof|nmap|curl|ping|grep)\b"
TESTING = r"\b(?:npm|pnpm|yarn|node)\s+(?:run\s+)?test\b|\b(?:pytest|cargo test|go test)\b"
MASKED = r"\|\|\s*true\b|;\s*(?:exit\s+0|true)\b"
TESTS_FAILED = r"\bnot pass(?:ed)?\b|\bdid not pass\b|\b0 tests? passed\b|\bno tests? (?:found|run)\b|\b[1-9]\d* (?:tests? )?failed\b|\bfailures?\s*[:=]\s*[1-9]\d*"
TESTS_PASSED = r"\b(?:[1-9]\d* tests? passed|all tests? passed|test(?:s)? passed|ok)\b"
FAILED = r"\b(?:inactive|dead|failed|failure|error|exception|keyerror|not found|missing|unavailable|unreachable|linkdown|no-carrier|permission denied|not permitted|timeout|timed out)\b"
# What a command is about, and how what it changed or its output is told: the first form counts; $1, $2 are its groups.
SUBJECTS = (
    (r"\bsystemctl\s+(?:--\S+\s+)*(?:is-active|status|restart|start|stop|enable|disable)\s+(?:--\S+\s+)*([\w@.-]+)", "service $1"), (r"\b(?:ss|netstat|lsof|nmap)\b.*?(?::|-p\s+)(\d{2,5})\b", "port $1"),
    (r"(?::|-p\s+)(\d{2,5})\b.*?\b(?:ss|netstat|lsof|nmap)\b", "port $1"), (f"(?:{TESTING})()", "test run$1"), (r"\bdocker\s+compose\b()", "Docker Compose services$1"), (r"\b(?:apt|apt-get|dnf|yum|pacman)\s+(?:-\S+\s+)*install\b()", "package installation$1"),
    (r"^(?:sudo\s+)?(?:[\w.-]*/)*([\w.-]+)", "$1 operation"),
)
CHANGES = (
    (r"\bsed\s+-i\s+['\"]s/[\^\s]*([^/]+)/([^/]+)/[g]?['\"]\s+([^\s;&|\"']+)", "$3: $1 -> $2 changed; result: "), (r"\bprintf\s+['\"]?([^'\"\s]+)['\"]?\s*>\s*([^\s;&|]+)", "$2 set to $1 changed; result: "),
    (r"\bsystemctl\s+restart\s+(?:--\S+\s+)*([\w@.-]+)", "Service $1 was restarted; result: "), (r"\bsystemctl\s+start\s+(?:--\S+\s+)*([\w@.-]+)", "Service $1 was started; result: "), (r"\bsystemctl\s+stop\s+(?:--\S+\s+)*([\w@.-]+)", "Service $1 was stopped; result: "),
    (r"\bsystemctl\s+enable\s+(?:--\S+\s+)*([\w@.-]+)", "Service $1 was enabled; result: "), (r"\bsystemctl\s+disable\s+(?:--\S+\s+)*([\w@.-]+)", "Service $1 was disabled; result: "), (r"\bdocker\s+compose\s+up\b()", "Docker Compose services were started; result: $1"),
    (r"\b(?:apt|apt-get|dnf|yum|pacman)\b.*\binstall\b()", "Package installation completed; result: $1"), (r"\b(?:mv|cp)\s+(?:-\S+\s+)*([^\s]+)\s+([^\s;&|]+)", "$1 -> $2 changed; result: "), (r"\b(?:tee(?:\s+-\S+)*|sed\s+-i(?:\s+[^\s]+)?)\s+([^\s;&|]+)", "$1 changed; result: "),
)
FAILURES = ((r"\bdefault\s+via\s+(\d+(?:\.\d+){3})\s+dev\s+([\w.-]+)[^;\n]*\blinkdown\b", "Default-Route via $1 dev $2: linkdown"),)
FINDINGS = ((r"(\d+(?:\.\d+){3}/\d+)\s+via\s+\d+(?:\.\d+){3}\s+dev\s+([\w.-]+)", "Route $1 via $2 verified"), (r"^.*(?:[^\d.]|^)(\d+(?:\.\d+){3})[^;]*?(?:synology|DSM)", "$1 Synology DSM verified"))
EXPLICIT = 0.95


def form_of(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The form of the first rule whose pattern the text has, with the groups of its first match; null without any."""
    return F.coalesce(*[F.when(matches(text, p), F.regexp_replace(text, f"(?isu)^.*?(?:{p}).*$", by)) for p, by in rules])


def inner(command: Column) -> Column:
    """The command on one line; of an ssh call with a quoted command that command."""
    remote = r"""(?i)^ssh\s+(?:(?:-[^\s]+)(?:\s+[^\s]+)?\s+)*[^\s]+\s+["'](.+)["']$"""
    return let(one_line(command), lambda c: F.when(F.regexp_like(c, F.lit(remote)), F.trim(F.regexp_replace(c, remote, "$1"))).otherwise(c))


def gist(output: Column) -> Column:
    """The first two lines of an output that say something; null if none does."""
    bare, _ = tx.redacted(output)
    lines = F.transform(F.split(bare, r"\n+"), lambda line: F.struct(plain(line).alias("text"), matches(line, SECRET).alias("secret")))
    said = F.slice(F.filter(lines, lambda x: (x["text"] != "") & ~x["secret"] & ~matches(x["text"], BABBLE)), 1, 2)
    return let(said, lambda s: F.when(F.size(s) > 0, truncated(F.array_join(F.transform(s, lambda x: x["text"]), "; "), MOST_RESULT)))


def told(pairs: DataFrame) -> DataFrame:
    """pairs (command, output, is_error, exit_code and others) with kind and segment of those that are worth a fact. A null
    exit code or flag says nothing; null commands and outputs count as empty."""
    c, r = F.col("_c"), F.col("_r")
    d = pairs.withColumn("_c", inner(F.coalesce("command", F.lit("")))).withColumn("_changing", matches(F.col("_c"), CHANGING))
    d = d.select("*", F.inline(F.array(F.struct(F.coalesce(gist(F.coalesce("output", F.lit(""))), F.when(F.col("_changing") & (F.col("exit_code") == 0), F.lit("exit code 0; no output"))).alias("_r")))))
    hidden = (c == "") | (F.length(c) > MOST_COMMAND) | (F.regexp_count(c, F.lit(r"&&|\|\||[|;]")) > MOST_JOINTS) | matches(F.trim(F.coalesce("command", F.lit(""))), HIDDEN[0]) & ~matches(F.coalesce("command", F.lit("")), r"^\s*ssh\b")
    for text in (c, F.coalesce("output", F.lit(""))):
        hidden = hidden | matches(text, SECRET) | (tx.redacted(text)[1] > 0)
    hidden = hidden | matches(c, HIDDEN[0])
    for p in LOOKING:
        hidden = hidden | matches(c, p)
    for p, q in POINTLESS:
        hidden = hidden | (matches(c, p) & matches(r, q))
    d = d.filter(r.isNotNull()).filter(~hidden)
    testing, ran_well = matches(c, TESTING), matches(r, TESTS_PASSED)
    bad = F.coalesce(F.col("is_error"), F.lit(False)) | F.coalesce(F.col("exit_code") != 0, F.lit(False)) | (testing & matches(r, TESTS_FAILED)) | matches(r, FAILED)
    checking = matches(c, CHECKING) & (~testing | ~matches(c, MASKED) | ran_well)
    kind = F.when(bad, "problem").when(checking, "verification").when(F.col("_changing"), "change").otherwise("result")
    about = F.coalesce(form_of(c, SUBJECTS), F.lit("command"))
    segment = (
        F.when(F.col("kind") == "problem", F.coalesce(form_of(r, FAILURES), F.concat(F.col("_about"), F.lit(" failed: "), r))).when(F.col("kind") == "verification", F.coalesce(form_of(r, FINDINGS), F.concat(F.col("_about"), F.lit(" was verified: "), r)))
        .when(F.col("kind") == "change", F.concat(F.coalesce(form_of(c, CHANGES), F.concat(F.col("_about"), F.lit(" completed a change; result: "))), r)).otherwise(F.concat(F.col("_about"), F.lit(" reported: "), r))
    )
    d = d.select("*", F.inline(F.array(F.struct(kind.alias("kind"), about.alias("_about")))))
    return d.withColumn("segment", segment).drop("_c", "_r", "_changing", "_about")


def command_candidates(pairs: DataFrame) -> DataFrame:
    """Candidates of facts (as facts.candidates gives) from pairs (session, ref, command, output, is_error, exit_code, context)."""
    t = told(pairs)
    s = t.select("session", F.lit("bash_pair").alias("source"), "context", F.col("kind").alias("fallback"), F.lit(EXPLICIT).alias("explicitness"), "segment", "ref", "command", "output", (F.col("kind") == "problem").alias("bad"))
    evidence = F.concat_ws("\0", one_line(F.col("command")), F.col("output"), F.when(F.col("bad"), "error").otherwise("success"))
    return kept(s, evidence, F.concat(F.lit("bash:"), F.col("ref").cast("string")))


#: Commands with outputs that put the rules to work; {n} is a number, the turn's first words are the output's last line.
SAMPLES = (
    ("sudo systemctl restart app{n}.service", "", 0), ("systemctl is-active app{n}", "active", 0), ("systemctl status db{n}", "inactive (dead)", 3), ("ss -ltn | grep :80{n}", "LISTEN 0 128", 0), ("npm run test", "{n} tests passed", 0), ("pytest -q || true", "3 failed", 0),
    ("docker compose up -d", "Started", 0), ("apt-get -y install nginx{n}", "done", 0), ("sed -i 's/port {n}/port 80/g' /etc/app.conf", "", 0), ("cp /etc/a{n} /etc/b", "", 0), ("ls -la", "total {n}", 0), ("curl -s http://h:80{n}/", "ok", 0), ("ip route show", "10.0.{n}.0/24 via 10.0.0.1 dev eth0", 0),
    ("ip route show default", "default via 10.0.0.1 dev eth{n} linkdown", 0), ("cat notes{n}", "", 0), ("printf 'on' > /sys/x{n}", "", 0), ("ssh -p 22 host{n} \"systemctl stop web{n}\"", "", 0), ("echo x; echo y; echo z; echo u; echo v", "x", 0), ("python run{n}.py", "DEBUG start", 1), ("pytest", "no tests found", 5),
)


def sample_pairs(turns: DataFrame) -> DataFrame:
    k = F.col("conv_id") * 7 + F.col("turn")
    pick = lambda i, kind: F.get(F.array(*[F.lit(x[i]).cast(kind) for x in SAMPLES]), F.pmod(k, F.lit(len(SAMPLES))).cast("int"))
    n = (F.col("conv_id") % 7 + 10).cast("string")
    said = F.substring_index(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", ""), " ", 3)
    filled = lambda c: F.replace(c, F.lit("{n}"), n)
    return turns.select(F.col("conv_id").alias("session"), F.col("turn").cast("string").alias("ref"), filled(pick(0, "string")).alias("command"), F.concat(filled(pick(1, "string")), F.lit("\n"), said).alias("output"), F.lit(None).cast("boolean").alias("is_error"), pick(2, "int").alias("exit_code"), F.lit("").alias("context"))


QUERIES = {"command_facts": lambda s, d: told(sample_pairs(dealt(s, d, "conversations"))).select("session", "ref", "kind", "segment")}
_Q = lambda p: p.replace("'", "''")
_HAS = lambda c, p: f"regexp_matches({c}, '(?i){_Q(p)}')"
_FORM = lambda c, rules: "coalesce(" + ", ".join(f"CASE WHEN {_HAS(c, p)} THEN regexp_replace({c}, '(?is)^.*?(?:{_Q(p)}).*$', '{_Q(by).replace('$', chr(92))}') END" for p, by in rules) + ")"
_LIST = lambda i: "[" + ", ".join(("'" + _Q(x[i]) + "'") if isinstance(x[i], str) else str(x[i]) for x in SAMPLES) + "]"
SQL = {
    "command_facts": f"""WITH t AS (SELECT conv_id AS session, CAST(turn AS VARCHAR) AS ref, (conv_id * 7 + turn) % {len(SAMPLES)} + 1 AS k, CAST(conv_id % 7 + 10 AS VARCHAR) AS n, array_to_string(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), ' ')[1:3], ' ') AS said FROM conversations),
      p AS (SELECT session, ref, replace(({_LIST(0)})[k], '{{n}}', n) AS command, replace(({_LIST(1)})[k], '{{n}}', n) || chr(10) || said AS output, ({_LIST(2)})[k] AS exit_code FROM t),
      c AS (SELECT *, CASE WHEN regexp_matches(command, '^ssh ') THEN regexp_extract(command, '"(.*)"$', 1) ELSE command END AS c,
        list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT {_HAS('x', BABBLE)})[1:2] AS lines FROM p),
      r AS (SELECT *, CASE WHEN len(lines) > 0 THEN array_to_string(lines, '; ') WHEN {_HAS('c', CHANGING)} AND exit_code = 0 THEN 'exit code 0; no output' END AS r FROM c),
      f AS (SELECT *, {_HAS('c', TESTING)} AS testing FROM r WHERE r IS NOT NULL AND len(regexp_extract_all(c, '&&|\\|\\||[|;]')) <= {MOST_JOINTS} AND NOT ({" OR ".join(_HAS("c", p) for p in LOOKING)})),
      k AS (SELECT *, coalesce({_FORM('c', SUBJECTS)}, 'command') AS about, CASE WHEN exit_code <> 0 OR testing AND {_HAS('r', TESTS_FAILED)} OR {_HAS('r', FAILED)} THEN 'problem' WHEN {_HAS('c', CHECKING)} AND (NOT testing OR NOT {_HAS('c', MASKED)} OR {_HAS('r', TESTS_PASSED)}) THEN 'verification'
        WHEN {_HAS('c', CHANGING)} THEN 'change' ELSE 'result' END AS kind FROM f)
      SELECT session, ref, kind, CASE kind WHEN 'problem' THEN coalesce({_FORM('r', FAILURES)}, about || ' failed: ' || r) WHEN 'verification' THEN coalesce({_FORM('r', FINDINGS)}, about || ' was verified: ' || r)
        WHEN 'change' THEN coalesce({_FORM('c', CHANGES)}, about || ' completed a change; result: ') || r ELSE about || ' reported: ' || r END AS segment FROM k""",
}
