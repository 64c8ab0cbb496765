from pyspark.sql import functions as F

from lorewell.operators import commands, facts

DDL = "session string, ref string, command string, output string, is_error boolean, exit_code int, context string"


def test_results_become_facts(spark):
    cases = [
        ("systemctl restart nginx.service", "", None, 0, ("change", "Service nginx.service was restarted; result: exit code 0; no output")),
        ("systemctl is-active nginx", "active", None, None, ("verification", "service nginx was verified: active")), ("systemctl status nginx", "inactive (dead)", None, 3, ("problem", "service nginx failed: inactive (dead)")),
        ("nmap -p 443 host", "443/tcp open", None, 0, ("verification", "port 443 was verified: 443/tcp open")), ("npm run test", "12 tests passed", None, 0, ("verification", "test run was verified: 12 tests passed")),
        ("pytest || true", "2 failed", None, 0, ("problem", "test run failed: 2 failed")), ("pytest || true", "done", None, 0, ("result", "test run reported: done")), ("sed -i 's/old/new/g' /etc/x.conf", "", None, 0, ("change", "/etc/x.conf: old -> new changed; result: exit code 0; no output")),
        ("printf 'on' > /sys/y", "", None, 0, ("change", "/sys/y set to on changed; result: exit code 0; no output")), ("mv /a /b", "moved", None, 0, ("change", "/a -> /b changed; result: moved")), ("docker compose up -d", "Started", None, 0, ("change", "Docker Compose services were started; result: Started")),
        ("ssh -p 22 root@h 'systemctl stop web'", "", None, 0, ("change", "Service web was stopped; result: exit code 0; no output")), ("ip route show", "10.0.1.0/24 via 10.0.0.1 dev eth0", None, 0, ("verification", "Route 10.0.1.0/24 via eth0 verified")),
        ("ip route show", "default via 10.0.0.1 dev eth1 proto linkdown", None, 0, ("problem", "Default-Route via 10.0.0.1 dev eth1: linkdown")), ("/usr/bin/uptime", "up 3 days\nDEBUG x\nload 1\nmore", None, 0, ("result", "uptime operation reported: up 3 days; load 1")),
        ("make all", "fine", True, None, ("problem", "make operation failed: fine")), ("sudo -n true", "sudo: a password is required", None, 1, None), ("timeout 5 x", "ok", None, 0, None), ("ls -la", "total 3", None, 0, None), ("git status", "clean", None, 0, None), ("node --version", "v1", None, 0, None),
        ("grep x y", "x", None, 0, None), ("cat x.env", "a", None, 0, None), ("curl --password hunter2hunter2 x", "ok", None, 0, None), ("echo", "token = abcdefghij", None, 0, None), ("a; b; c; d; e", "x", None, 0, None), ("x" * 300, "y", None, 0, None), ("uptime", "", None, 0, None), (None, None, None, None, None), ("cat <<E", "x", None, 0, None),
    ]
    df = spark.createDataFrame([("s", str(i), c, o, e, x, "") for i, (c, o, e, x, _) in enumerate(cases)], DDL)
    got = {int(r["ref"]): (r["kind"], r["segment"]) for r in commands.told(df).collect()}
    wrong = [(c[0], got.get(i), c[4]) for i, c in enumerate(cases) if got.get(i) != c[4]]
    assert wrong == []


def test_candidates_join_the_others(spark):
    df = spark.createDataFrame([("s", "7", "systemctl restart nginx.service", "", None, 0, "web"), ("s", "8", "systemctl status nginx", "inactive", None, 3, "web")], DDL)
    c = commands.command_candidates(df)
    text = spark.createDataFrame([("s", "1", "phase", "Der Dienst ist nicht erreichbar seit gestern", "web", "result", 0.5)], "session string, ref string, source string, text string, context string, fallback string, explicitness double")
    m = facts.factors(facts.merged(c.unionByName(facts.candidates(text))))
    rows = {r["statement"]: r for r in m.collect()}
    assert len(rows) == 3 and {r["evidence"][0]["source"] for r in rows.values()} == {"bash_pair", "phase"} and all(0 <= r["salience"] <= 100 for r in rows.values())
    assert commands.command_candidates(df.limit(0)).count() == 0
