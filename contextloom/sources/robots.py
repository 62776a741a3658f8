"""robots.txt: from its text to rules, and from rules to what may be fetched."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[bool, str]]  # (allow, prefix), in the order of the file


def prefix_of(value: str) -> str:
    """A rule's path as requests are compared with it: one way of escaping for all."""
    return quote(unquote(value))


def rule_path(value: str) -> str:
    """The same of an unescaped rule as the standard library has it, without empty parts; what is no address stays as it is."""
    try:
        return quote(urlunparse(urlparse(value)))
    except ValueError:
        return prefix_of(value)


def groups(text: str | None) -> list[tuple[list[str], Rules]]:
    """(agents, rules) of each group of the file.

    A group is one or more user-agent lines and the rules after them; an agent line after a rule begins the next one, and so does an
    empty line after a rule, one without even white space. Comments, unknown lines and rules without a group are passed over. ``Disallow:`` without a path allows all.
    """
    found: list[tuple[list[str], Rules]] = []
    agents: list[str] = []
    rules: Rules = []

    def close() -> None:
        if agents and rules:
            found.append((list(agents), list(rules)))
        agents.clear()
        rules.clear()

    for line in (text or "").splitlines():
        if not line:
            if not rules:  # agents that nothing follows are forgotten
                agents.clear()
            close()
            continue
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), unquote(value.strip())
        if not colon:
            continue
        if key == "user-agent":
            if rules:
                close()
            agents.append(value)
        elif key in ("allow", "disallow") and agents:
            rules.append((key == "allow" or not value, rule_path(value)))
    close()
    return found


def rules_for(found: list[tuple[list[str], Rules]], agent: str) -> Rules:
    """The rules of the first group that names the agent; else of the first one for all."""
    name = agent.split("/")[0].lower()
    for agents, rules in found:
        if "*" not in agents and any(a.lower() in name for a in agents):
            return rules
    return next((rules for agents, rules in found if "*" in agents), [])


def may_fetch(rules: Rules, path: str, first_match: bool = False) -> bool:
    """Whether a path (with its query) may be fetched: by the longest rule that begins it, of equal ones an allowing one.

    ``first_match`` takes the first such rule in the order of the file instead. Without one it may.
    """
    path = prefix_of(path or "/")
    fits = [(len(prefix), allow) for allow, prefix in rules if prefix == "*" or path.startswith(prefix)]
    if not fits:
        return True
    return fits[0][1] if first_match else max(fits)[1]


@F.udtf(returnType="place int, allow boolean, prefix string")
class RobotsRules:
    """The rules that a file has for an agent, a row each."""

    def eval(self, text: str, agent: str) -> Iterator[tuple[int, bool, str]]:
        for place, (allow, prefix) in enumerate(rules_for(groups(text), agent)):
            yield place, allow, prefix


def robots_rules(files: DataFrame, agent: str = "*", host: str = "host", text: str = "text") -> DataFrame:
    """(host, place, allow, prefix) of the files of hosts (host, text): the rules that hold for the agent, in the order of the file."""
    return files.select(host, text).lateralJoin(RobotsRules(F.col(text).outer(), F.lit(agent))).select(F.col(host).alias("host"), "place", "allow", "prefix")


def robots_allowed(pages: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", first_match: bool = False) -> DataFrame:
    """``pages`` with allowed, as ``may_fetch`` has it; ``rules`` as ``robots_rules`` gives them, place being optional.

    A host has few rules, so they are gathered by host and joined once.
    """
    place = F.col("place") if "place" in rules.columns else F.lit(0)
    rank = -place if first_match else F.length("prefix")
    by_host = rules.groupBy(F.col("host").alias(host)).agg(F.collect_list(F.struct(rank.alias("rank"), "allow", "prefix")).alias("rules"))
    fits = F.filter("rules", lambda r: (r["prefix"] == "*") | escaped(F.col(path)).startswith(r["prefix"]))
    return pages.join(by_host, host, "left").withColumn("allowed", F.coalesce(F.array_max(fits)["allow"], F.lit(True))).drop("rules")


def escaped(path: Column) -> Column:
    """Characters of a path that need it as %XX; those that are escaped already stay."""
    return F.coalesce(F.when(path.rlike(r"^[A-Za-z0-9_.~/%-]*$"), path), F.regexp_replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), "%2F", "/"))
