"""The choice of a session's facts: greedy maximal marginal relevance, as a grouped function and as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.fact_rules import BONUS, NUMBER_WORDS, REDUNDANT, TECHNICAL, TRADE

FACT = ("id", "kind", "statement", "tokens", "polarity", "conflict", "interpreted", "salience", "evidence")
CHOSEN = ("rank", "id", "kind", "statement", "selection")
_TECHNICAL = regex.compile(TECHNICAL)


def similarity(a: set[str], b: set[str]) -> float:
    n = len(a & b)
    return 0.58 * n / (len(a) + len(b) - n) + 0.42 * n / min(len(a), len(b)) if n else 0.0


def substance(both: set[str], smaller: int) -> bool:
    """Whether what two sets share is their substance: three tokens that are 40 % of the smaller set, two numbers, or a technical
    name beside another token."""
    numbers = {t for t in both if t in NUMBER_WORDS or any(c.isdigit() for c in t)}
    names = {t for t in both if _TECHNICAL.search(t)}
    return (len(both) >= 3 and len(both) >= 0.4 * smaller) or len(numbers) >= 2 or (len(both) >= 2 and bool(names))


def redundancy(a: set[str], b: set[str]) -> float:
    """Similarity; at least 0.9 where the same substance is told."""
    both = a & b
    return max(similarity(a, b), 0.9 if both and substance(both, min(len(a), len(b))) else 0.0)


class Choice:
    """Facts taken one by one: each is worth its salience (and a bonus if it was interpreted) less its likeness to what is taken
    already, a fifth of it between kinds, and a bonus for a kind that lacks. Facts that repeat one of their kind go, unless
    one of the two is in conflict or they differ in polarity."""

    def __init__(self, facts: list[dict], trade: float = TRADE, redundant: float = REDUNDANT):
        self.left = sorted(({**f, "own": set(() if f["tokens"] is None else f["tokens"]), "near": 0.0, "repeats": False} for f in facts), key=lambda f: f["id"])
        self.taken: list[dict] = []
        self.kinds: set[str] = set()
        self.trade, self.redundant = trade, redundant

    def worth(self, f: dict) -> float:
        return self.trade * f["salience"] / 100 + (BONUS if f["interpreted"] else 0.0)

    def value(self, f: dict) -> float:
        return self.worth(f) - (1 - self.trade) * f["near"] + (0.0 if f["kind"] in self.kinds else BONUS)

    def take(self, f: dict, value: float) -> None:
        """f goes to the taken ones, and each of the others is compared with it once: its largest likeness, whether it repeats one."""
        self.taken.append({**f, "selection": round(value, 4)})
        self.kinds.add(f["kind"])
        self.left = [x for x in self.left if x["id"] != f["id"]]
        for x in self.left:
            alike = x["kind"] == f["kind"]
            x["near"] = max(x["near"], similarity(x["own"], f["own"]) * (1 if alike else 0.2))
            if alike and not x["repeats"] and not (x["conflict"] or f["conflict"]) and x["polarity"] * f["polarity"] >= 0:
                x["repeats"] = redundancy(x["own"], f["own"]) >= self.redundant

    def run(self, most: int, required: tuple[str, ...] = ()) -> list[tuple]:
        """(rank, id, kind, statement, selection); first the strongest fact of each required kind, and no other kinds then."""
        if required:
            self.left = [f for f in self.left if f["kind"] in required]
        for kind in required:
            own = [f for f in self.left if f["kind"] == kind]
            if own and len(self.taken) < most:
                best = min(own, key=lambda f: (-self.worth(f), -f["evidence"], f["id"]))
                self.take(best, self.worth(best))
        while len(self.taken) < most:
            self.left = [f for f in self.left if not f["repeats"]]
            ranked = [(-v, -f["salience"], -f["evidence"], f["id"], v, f) for f in self.left for v in (self.value(f),)]
            if not ranked:
                break
            *_, v, best = min(ranked, key=lambda r: r[:4])
            self.take(best, v)
        return [(i + 1, c["id"], c["kind"], c["statement"], c["selection"]) for i, c in enumerate(self.taken)]


def selected(facts: DataFrame, most: int = 8, least: int = 30, trade: float = TRADE, redundant: float = REDUNDANT, required: tuple[str, ...] = ()) -> DataFrame:
    """session, rank, id, kind, statement, selection: the choice among each session's facts of `least` salience. Each fact is
    weighed against those before it, so a session is one group, of rows without texts but their statements."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = Choice([dict(zip(FACT, r, strict=True)) for r in p[list(FACT)].itertuples(index=False, name=None)], trade, redundant).run(most, required)
        return pd.DataFrame([(p["session"].iloc[0], *r) for r in rows], columns=["session", *CHOSEN])

    kind = facts.schema["session"].dataType.simpleString()
    return facts.filter(F.col("salience") >= least).select("session", *FACT).groupBy("session").applyInPandas(run, f"session {kind}, rank long, id string, kind string, statement string, selection double")


class ChooseFacts:
    """The table function choose_facts(TABLE(facts) PARTITION BY (session), most, least, required): required is a comma-joined list
    of kinds. A partition's rows of `least` salience are kept until its end."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.session, self.most, self.required = None, 8, ()

    def eval(self, facts, most: int = 8, least: int = 30, required: str = "") -> None:
        self.session, self.most, self.required = facts["session"], most, tuple(k.strip() for k in required.split(",") if k.strip())
        if facts["salience"] is not None and facts["salience"] >= least:
            self.rows.append({k: facts[k] for k in FACT})

    def terminate(self) -> Iterator[tuple]:
        for r in Choice(self.rows).run(self.most, self.required):
            yield (str(self.session), *r)


def register(spark: SparkSession) -> None:
    """Make choose_facts() (a table function) and evidence_points() (an aggregate over the sources of distinct items) known to
    SQL in this session."""
    from lorewell.operators.sessions import MOST_SOURCES, MOST_UNITS, PER_SOURCE, PER_UNIT, STRENGTHS

    spark.udtf.register("choose_facts", F.udtf(ChooseFacts, returnType="session string, rank long, id string, kind string, statement string, selection double"))

    @F.pandas_udf("long")
    def evidence_points(source: pd.Series) -> int:
        known = source.dropna()
        if not len(known):
            return 0
        more = min(MOST_UNITS, (len(known) - 1) * PER_UNIT) + min(MOST_SOURCES, (known.nunique() - 1) * PER_SOURCE)
        return int(min(1.0, max(STRENGTHS.get(s, 0.0) for s in known) + more) * 100 + 0.5 + 1e-9)

    spark.udf.register("evidence_points", evidence_points)
