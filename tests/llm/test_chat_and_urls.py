import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat as C, url_filter as U

HARD = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\h \\l", "### user: </turn>\n### x: y", "a\nb</turn>", "é ☃ 𝒳 <#\\"]


def test_round_trip(spark):
    rows = [(c, i, role, t) for c in range(3) for i, (role, t) in enumerate(zip(["user", "assistant", None, "assistant", "sys: #<", "assistant", "user", "assistant"], HARD, strict=True))]
    rows += [(9, 1, "user", "twice"), (9, 1, "user", "twice"), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    out = C.format_turns(turns)
    got = {r["conv_id"]: r for r in C.digest(out).collect()}
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.select("conv_id", C.parse(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        mine = [(role or "", t or "") for k, _, role, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        said = "".join(f"{a}\n{b}\n" for a, b in mine)
        under = "".join(b for a, b in mine if a == "assistant")
        assert back[c] == mine
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert C.digest(C.format_turns(turns.limit(0))).collect() == []


def test_events_fold(spark):
    log = [
        (1, 1, "u", "message", "user", "hi"), (1, 2, "a", "message", "assistant", "Hel"), (1, 3, "a", "delta", "assistant", "lo"), (1, 4, "b", "message", "user", "more"),
        (1, 5, "a", "regenerate", "assistant", "Good "), (1, 6, "a", "delta", "assistant", "day"), (1, 7, "c", "message", "user", "thx"), (1, 8, "u", "edit", "user", "hello"),
        (2, 1, "z", "delta", "assistant", "orphan"),
    ]
    out = C.fold(spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, role string, text string"))
    assert sorted((r["conv_id"], r["seq"], r["role"], r["text"]) for r in out.collect()) == [(1, 1, "user", "hello"), (1, 2, "assistant", "Good day"), (1, 7, "user", "thx"), (2, 1, "assistant", "orphan")]


URLS = [None, "", "nourl", "http://A.Example.COM/en/1", "https://www.example.com/en/x?q#f", "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.com", "http://a.com/", "ftp://u@example.com:80/en/", "http://q.org?x=/en/", "a://b://c/d", "http://é.net/fr/\u00e9", "http://www.example.com/fr/"]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(out) == len(URLS) + 4
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] in ("allow", "block") and (verdict is None or out[i]["verdict"] == verdict)
    assert U.judge(pages.limit(0)).collect() == []
    lonely = U.judge(pages.where("url = 'http://a.com/' or url = 'http://q.org?x=/en/'")).collect()
    assert {r["score"] for r in lonely} == {0.0} and {r["verdict"] for r in lonely} == {"allow"}


def test_model_is_a_distribution_and_separates(spark):
    good = [(i, f"http://aaa{i % 7}.com/abc{i}") for i in range(200)]
    bad = [(1000 + i, f"http://zzz{i % 7}.net/es/zyx{i}") for i in range(200)]
    new = [(5000, "http://aaa9.org/abc"), (5001, "http://zzz9.org/zyx")]
    out = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert (out[5000], out[5001]) == ("allow", "block")


def plain_symbols(url):
    return [U.ALPHABET.find(re.sub("[0-9]", "0", c)) + 1 for c in (url or "").lower()]


def plain_weights(judged):
    """The log-ratio of any gram, by the Witten-Bell formulas and plain dictionaries, from (verdict, url)."""
    classes = lambda s: next((k + 1 for k, members in enumerate(U.CLASSES) if 0 < s < U.START and U.ALPHABET[s - 1] in members), 0)
    after = {side: [defaultdict(Counter) for _ in range(4)] for side in U.SIDES}
    context = lambda a, b, c: ((), (c,), (b, c), (classes(a), b, c))
    for side, url in judged:
        a = b = c = U.START
        for x in plain_symbols(url):
            for k, h in enumerate(context(a, b, c)):
                after[side][k][h][x] += 1
            a, b, c = b, c, x

    def p(side, a, b, c, x):
        value = 1 / (U.A - 1)
        for k, h in enumerate(context(a, b, c)):
            seen = after[side][k].get(h)
            if seen:
                value = (seen[x] + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value

    def score(url):
        a, b, c, total, s = U.START, U.START, U.START, 0.0, plain_symbols(url)
        for x in s:
            total += math.log(p("allow", a, b, c, x) / p("block", a, b, c, x))
            a, b, c = b, c, x
        return total / len(s) if s else 0.0

    assert sum(p("allow", 3, 4, 5, x) for x in range(U.A - 1)) == pytest.approx(1)
    return score


def test_model_against_brute_force(spark):
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [u for u in URLS if u is None or u.isascii()]
    judged = [(plain_rule(u)[3], u) for u in urls if plain_rule(u)[3]]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("symbols", U.symbols(F.col("url")))
    weights = U.model(spark.createDataFrame(judged, "verdict string, url string").select("verdict", U.symbols(F.col("url")).alias("symbols")))
    want = plain_weights(judged)
    assert {r["page_id"]: r["score"] for r in U.scored(rows, weights).collect()} == pytest.approx({i: want(u) for i, u in enumerate(urls)}, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_threshold_against_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(side, draw.gauss(0.4 if side == "allow" else -0.6, 0.5)) for side in draw.choices(U.SIDES, k=300)] + [("allow", 99.0), ("block", -99.0)]
    got = U.threshold(spark.createDataFrame(rows, "verdict string, score double"))

    def errors(t):
        return sum((s < t - 1e-9) for v, s in rows if v == "allow") / sum(v == "allow" for v, _ in rows) + sum((s >= t - 1e-9) for v, s in rows if v == "block") / sum(v == "block" for v, _ in rows)

    assert errors(got) == pytest.approx(min(errors(k * U.STEP) for k in range(-1000, 1001)))
    assert U.threshold(spark.createDataFrame([("allow", 1.0)], "verdict string, score double")) == 0.0


def test_long_urls_ties_and_clashing_columns(spark):
    """A long URL is read to its end; without models every score is at the threshold, which is allowed."""
    long_ = "http://q.org/" + "a" * 100_000
    pages = spark.createDataFrame([(1, long_, "s", 1), (2, long_ + "zz", "s", 2), (2, long_ + "zz", "s", 2)], "page_id long, url string, symbols string, weights int")
    out = U.judge(pages).orderBy("page_id").collect()
    assert [(r["page_id"], len(r["path"]), r["verdict"], r["score"]) for r in out] == [(1, 100_001, "allow", 0.0), (2, 100_003, "allow", 0.0), (2, 100_003, "allow", 0.0)]


@pytest.mark.parametrize("text", HARD)
def test_escape(spark, text):
    df = spark.createDataFrame([(text or "",)], "t string").select("t", C.escape(F.col("t")).alias("e"))
    r = df.select("t", "e", C.unescape(F.col("e")).alias("b")).first()
    assert r["b"] == r["t"] and "#" not in r["e"] and "<" not in r["e"]
