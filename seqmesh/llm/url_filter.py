"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are summed by host, registered domain and suffix. The suffix is the last label, or the
last two where registrants are one level down (``SUFFIXES``, as in co.uk); the registered domain is the suffix and one
label more. User names, ports and a last dot are no part of either; numeric hosts are domains of their own, under one
suffix. Each level's bad rate has a beta prior centred on the level above; its strength comes from the intraclass
correlation of that level's units (analysis-of-variance estimator), so levels whose units agree shrink hard and levels
whose units differ shrink little. A host is blocked when the lower bound of its posterior bad rate, mean less ``z``
standard deviations, exceeds ``max_bad``; hosts without outcomes fall back on their domain's rate and are that uncertain.

Scale: urls are parsed and counted in one pass with map-side sums, so a hot host sends one row a task. Pages meet only
the table of blocked hosts, by a left join that adaptive execution splits for hot hosts; nothing is broadcast by hand.
The driver sees three rows of level statistics.

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and is judged as host "";
repeated pages come out as often as they came in and count as often; a page_id with several outcomes is bad if any of
them is; null outcomes and null page_ids in outcomes are left out; without outcomes everything unruled is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.common import ascii_lower
from seqmesh.session import materialise

#: verdict and rule; a rule is host/path-prefix and covers subdomains.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
Z, MAX_BAD = 1.645, 0.2
#: Bounds of the intraclass correlation, so that a prior is worth between 1 and 999 outcomes.
RHO = (0.001, 0.5)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


# Suffixes of two labels under which the public registers names, by country.
SUFFIXES = """
com.ar gob.ar org.ar ac.at co.at or.at com.au edu.au gov.au id.au net.au org.au com.br edu.br gov.br net.br org.br
com.cn edu.cn gov.cn net.cn org.cn com.co edu.co gov.co com.eg edu.eg com.hk edu.hk gov.hk org.hk co.id ac.id go.id
or.id co.il ac.il org.il ac.in co.in edu.in gov.in net.in org.in ac.jp co.jp ed.jp go.jp ne.jp or.jp ac.ke co.ke or.ke
ac.kr co.kr go.kr or.kr com.mx edu.mx gob.mx org.mx com.my edu.my gov.my com.ng edu.ng gov.ng ac.nz co.nz govt.nz
net.nz org.nz com.pe edu.pe com.ph edu.ph gov.ph com.pk edu.pk com.pl edu.pl net.pl org.pl com.pt edu.pt com.sa
edu.sa com.sg edu.sg gov.sg ac.th co.th go.th in.th com.tr edu.tr gov.tr org.tr com.tw edu.tw gov.tw org.tw com.ua
edu.ua org.ua ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.uy edu.uy com.ve com.vn edu.vn
gov.vn ac.za co.za gov.za org.za
""".split()
#: The suffix that numeric hosts share.
NUMERIC = "#"


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    bare = F.regexp_replace(bare, r"\.$", "")
    numeric = bare.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    two = F.substring_index(bare, ".", -2)
    deep = two.isin(SUFFIXES)
    domain = F.when(numeric, bare).when(deep, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(numeric, F.lit(NUMERIC)).when(deep, two).otherwise(F.substring_index(bare, ".", -1))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule(rules: list[tuple[str, str]], what: int) -> Column:
    """The verdict (0) or text (1) of the longest rule that fits columns host and path; of equal length the first given."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, tail = r[1].partition("/")
        at = (F.col("host") == name) | F.col("host").endswith("." + name)
        out = F.when(at & F.col("path").startswith("/" + tail), F.lit(r[what])).otherwise(out)
    return out


def _strength(units: DataFrame) -> float:
    """What the prior of these units (n, k) is worth in outcomes."""
    u = units.where("n > 0").select(F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"))
    s = u.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    rho = RHO[1]  # too few units to tell: the weakest prior
    if s.m > 1 and s.n > s.m:
        between, within = (s.q - s.k * s.k / s.n) / (s.m - 1), (s.k - s.q) / (s.n - s.m)
        size = (s.n - s.nn / s.n) / (s.m - 1)
        below = between + (size - 1) * within
        rho = (between - within) / below if below > 0 else RHO[0]
    rho = min(max(rho, RHO[0]), RHO[1])
    return round((1 - rho) / rho, 6)


def reputations(seen: DataFrame, z: float = Z, max_bad: float = MAX_BAD) -> DataFrame:
    """A row for each host of ``seen`` (host, bad: 1, 0 or null): n, k, posterior mean and lower bound of the bad rate, blocked."""
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("host"))
    hosts = materialise(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s, d, h = (_strength(x) for x in (suffixes, domains, hosts))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = (1 + (whole.k or 0)) / (2 + (whole.n or 0))
    mean_s = suffixes.select("suffix", ((F.lit(s * top) + F.col("k")) / (F.lit(s) + F.col("n"))).alias("mean_s"))
    mean_d = domains.join(mean_s, "suffix").select("domain", ((F.lit(d) * F.col("mean_s") + F.col("k")) / (F.lit(d) + F.col("n"))).alias("mean_d"))
    post = hosts.join(mean_d, "domain").withColumn("mean", (F.lit(h) * F.col("mean_d") + F.col("k")) / (F.lit(h) + F.col("n")))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(h + 1) + F.col("n")))
    return post.withColumn("bound", bound).select("host", "n", "k", "mean", "bound", (F.col("bound") > max_bad).alias("blocked"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None, z: float = Z, max_bad: float = MAX_BAD) -> DataFrame:
    """Judge ``pages`` (page_id, url) given ``outcomes`` (page_id, bad): page_id, host, path, rule, verdict."""
    rules = RULES if rules is None else rules
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    blocked = reputations(parsed.select("page_id", "host").join(known, "page_id", "left"), z, max_bad).where("blocked").select("host", F.lit(True).alias("blocked"))
    ruled = parsed.join(blocked, "host", "left").withColumns({"rule": rule(rules, 1), "by_rule": rule(rules, 0)})
    other = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("by_rule", other).alias("verdict"))
