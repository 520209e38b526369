"""URL filters: path rules first, then trust propagated over host links.

Only DataFrame functions run on this path. Hosts with pages that the rules allow are trusted seeds, hosts with pages that
they block are distrusted. Trust follows links by personalised PageRank, distrust runs against them (who links to a
blocked host is suspect), and a page without a rule gets its host's verdict. Ranks are in pages: the trust of all hosts
adds up to the number of allowed pages, the distrust to that of blocked ones, so evidence weighs alike at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, small_enough

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of a rank that follows links, and share of all rank that may still move in a round at the end.
DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is blocked if its distrust exceeds its trust and is at least this many blocked pages for each page that it has.
EVIDENCE = 0.25
BROADCAST_ROWS = 500_000
#: What precedes the host of an absolute link.
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//"""


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path) that fits and its verdict, or nulls; the longest wins, of equally long ones the first by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    p = pages.select("page_id", F.col("url").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and n (links) between different hosts, from absolute links; relative ones stay on their host."""
    after = F.split(F.coalesce("html", F.lit("")), _LINK)
    p = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))).alias("x"))
    p = p.select("src", ascii_lower(F.regexp_extract("x", r"""^([^/?#"'<>\s]*)""", 1)).alias("dst"))
    return p.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust from seeds (host, trusted, blocked: pages) over links (src, dst, n).

    Personalised PageRank: a host passes its trust to the hosts it links to, by number of links, and its distrust to those
    that link to it; what hosts without such links hold returns to the seeds, so no rank is lost. Rounds end when less
    than the tolerance's share of all rank moves; each round shrinks what moves by the damping, so they do end. Each
    round's ranks are written to the shared folder and the last round's deleted.
    """
    seeds = materialize(seeds.select("host", F.col("trusted").cast("double").alias("st"), F.col("blocked").cast("double").alias("sd")), "seeds")
    total = seeds.agg(F.sum("st").alias("t"), F.sum("sd").alias("d")).first()
    all_t, all_d = total.t or 0.0, total.d or 0.0
    out = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    into = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    edges = links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out_n")).alias("wt"), (F.col("n") / F.col("in_n")).alias("wd"))
    edges = materialize(edges, "links")
    ends = edges.select(F.col("src").alias("host"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.unionByName(seeds.select("host", F.lit(0).alias("o"), F.lit(0).alias("i"))).groupBy("host").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    base = ends.join(seeds, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("st", "sd")], F.col("o").alias("has_out"), F.col("i").alias("has_in"))
    base = materialize(base, "hosts")
    ranks = base.select("host", F.col("st").alias("trust"), F.col("sd").alias("distrust"))
    if not edges.head(1):
        return ranks
    zero = F.lit(0.0)
    while True:
        stuck = base.join(ranks, "host").agg(F.sum(F.when(F.col("has_out") == 0, F.col("trust"))).alias("t"), F.sum(F.when(F.col("has_in") == 0, F.col("distrust"))).alias("d")).first()
        back_t, back_d = (damping * (x or 0.0) / all_ if all_ else 0.0 for x, all_ in ((stuck.t, all_t), (stuck.d, all_d)))
        down = edges.join(ranks, edges["src"] == ranks["host"]).select(F.col("dst").alias("h"), (F.col("wt") * F.col("trust")).alias("t"), zero.alias("d"))
        up = edges.join(ranks, edges["dst"] == ranks["host"]).select(F.col("src").alias("h"), zero.alias("t"), (F.col("wd") * F.col("distrust")).alias("d"))
        got = down.unionByName(up).groupBy("h").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = base.join(got, base["host"] == got["h"], "left").join(ranks, "host")
        trust = F.col("st") * (1 - damping + back_t) + damping * F.coalesce("t", zero)
        distrust = F.col("sd") * (1 - damping + back_d) + damping * F.coalesce("d", zero)
        moved = [F.abs(trust - F.col("trust")).alias("mt"), F.abs(distrust - F.col("distrust")).alias("md")]
        new = materialize(new.select("host", trust.alias("trust"), distrust.alias("distrust"), *moved), "ranks")
        move = new.agg(F.sum("mt").alias("t"), F.sum("md").alias("d")).first()
        discard(ranks)
        ranks = new
        if (move.t or 0.0) <= tolerance * all_t and (move.d or 0.0) <= tolerance * all_d:
            return ranks.select("host", "trust", "distrust")


def host_verdicts(hosts: DataFrame, links: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """host, trust, distrust and bad (boolean) of hosts (host, pages, trusted, blocked) over links (src, dst, n)."""
    ranks = propagate(hosts.select("host", "trusted", "blocked"), links)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= evidence * F.col("pages"))
    return hosts.select("host", "pages").join(ranks, "host").select("host", "trust", "distrust", bad.alias("bad"))


def hosts_of(ruled: DataFrame) -> DataFrame:
    """host, pages, and how many of them the rules allow (trusted) and block (blocked), from rows (host, ruled)."""
    count = lambda kind: F.sum(F.when(F.col("ruled") == kind, 1).otherwise(0)).alias({"allow": "trusted", "block": "blocked"}[kind])
    return ruled.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow"), count("block"))


def judge(pages: DataFrame, rules=RULES, evidence: float = EVIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null for an empty host), for every row of pages.

    A null url, or one without `://`, has an empty host and path, no rule, and is allowed; a null html has no links.
    Repeated rows count as pages of their own. An empty table gives an empty result.
    """
    ruled = judged_by_rules(pages, rules)
    hosts, links = materialize(hosts_of(ruled), "seed_pages"), materialize(host_links(pages), "host_links")
    ranks = materialize(host_verdicts(hosts, links, evidence), "verdicts")
    discard(hosts, links)
    side = F.broadcast(ranks) if small_enough(ranks, BROADCAST_ROWS) else ranks
    method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return ruled.join(side, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def derived_links(pages: DataFrame) -> DataFrame:
    """Links between hosts of a table whose pages hold none, for tests of the propagation: page n of one host links to the
    hosts of pages 3n + 1 and n // 2, so there are hubs, cycles and hosts without links."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''")
    to = p.select("host", F.explode(F.array(3 * F.col("page_id") + 1, F.floor(F.col("page_id") / 2))).alias("to"))
    other = p.select(F.col("page_id").alias("to"), F.col("host").alias("dst"))
    e = to.join(other, "to").where(F.col("host") != F.col("dst"))
    return e.groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def judge_derived(pages: DataFrame) -> DataFrame:
    """host and verdict by propagation over derived_links(): what the rules say of a host's pages is only its seed."""
    out = host_verdicts(materialize(hosts_of(judged_by_rules(pages)), "seed_pages"), materialize(derived_links(pages), "host_links"))
    return out.select("host", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"), F.round("trust", 3).alias("trust"), F.round("distrust", 3).alias("distrust"))
