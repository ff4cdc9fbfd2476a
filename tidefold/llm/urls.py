"""URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidefold.llm.common import table

#: Rules whose index one pass sends to every executor; longer lists take more passes.
MAX_RULES = 200_000

SITE, PATTERN = "site", "pattern"


@dataclass(frozen=True)
class Rule:
    """``site``: ``host/path``, fits the host, its subdomains and paths that start so.
    ``pattern``: text with ``*`` for anything, fits host and path as a whole."""

    text: str
    verdict: str
    kind: str = SITE

    def expression(self) -> str:
        if self.kind == SITE:
            return r"(?s)\A(?:[^/]*\.)?" + re.escape(self.text)
        return r"(?s)\A" + ".*".join(map(re.escape, self.text.split("*"))) + r"\Z"

    def tokens(self) -> set[str]:
        """Literal tokens that any fitting URL holds whole, between its separators."""
        if self.kind == SITE:  # begins at a label, may go on after its end
            parts = ["/" + self.text]
        else:
            parts = self.text.split("*")
            parts[0], parts[-1] = "/" + parts[0], parts[-1] + "/"
        return {t for part in parts for t in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", part)}


#: Fixed values of the contract, and the patterns that judge where no rule fits.
SITE_RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
PATTERN_RULES = tuple(
    Rule(text, "block", PATTERN)
    for text in (
        "*adult-x.*", "*cheap-pills.*", "*free-bets.*", "*spam-farm.*", "*casino-*.*", "*/wp-login.php*",
    )
)


def token_index(rules: Sequence[tuple[int, Rule]]) -> tuple[dict[str, list], list]:
    """Rules (number, verdict, kind, length, expression) by rarest token; those without one."""
    frequency = Counter(t for _, rule in rules for t in rule.tokens())
    index: dict[str, list] = {}
    rest: list = []
    for number, rule in rules:
        entry = (number, rule.verdict, rule.kind, len(rule.text), rule.text, rule.expression())
        rarest = min(rule.tokens(), key=lambda t: (frequency[t], -len(t), t), default=None)
        (rest if rarest is None else index.setdefault(rarest, [])).append(entry)
    return index, rest


_AUTHORITY = re.compile(r"(?s)://([^/?#]*)([^?#]*)")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _AUTHORITY.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def judge(host: str, path: str, index, rest, compiled: dict) -> tuple:
    """Best site rule and first block pattern: (length, -number, text, verdict), (number, text)."""
    whole = host + path
    site, pattern = None, None
    seen = dict.fromkeys(_TOKEN.findall(whole))
    for entries in (rest, *(index[t] for t in seen if t in index)):
        for number, verdict, kind, length, text, expression in entries:
            if kind == SITE and site and (length, -number) < site[:2]:
                continue
            fits = compiled.get(number) or compiled.setdefault(number, re.compile(expression))
            if not fits.search(whole):
                continue
            if kind == SITE:
                site = (length, -number, text, verdict)
            elif pattern is None or number < pattern[0]:
                pattern = (number, text, verdict)
    return site, pattern


RESULT = (
    "page_id long, host string, path string, rule string, verdict string, pattern string"
)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = SITE_RULES + PATTERN_RULES,
                max_rules: int = MAX_RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``pattern`` of each row.

    Every rule is kept under the rarest (over all rules) of the literal tokens that a
    fitting URL has to hold; a URL looks up its own tokens and runs only the expressions
    found there, and those of rules without a literal token. The longest fitting site
    rule decides, ties go to the first; without one, the first fitting pattern; else the
    verdict is allow. No shuffle; pages are independent, so no host can be hot. The index
    goes to executors once for ``max_rules`` rules; more rules take further passes that
    keep the best rule so far.

    A null URL or one without ``://`` has empty host and path and is allowed. Repeated
    rows are judged alike, an empty table gives no rows, other columns are not read.
    """
    spark = pages.sparkSession
    numbered = list(enumerate(rules))
    passes = [numbered[i : i + max_rules] for i in range(0, len(numbered), max_rules)] or [[]]
    frame = pages.select("page_id", "url")
    wide = "page_id long, url string, s_length long, s_number long, s_rule string," \
        " s_verdict string, p_number long, p_rule string, p_verdict string"
    for one in passes:
        sent = spark.sparkContext.broadcast(token_index(one))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (index, rest), compiled = sent.value, {}
            schema = _schema(wide)
            for batch in batches:
                rows = batch.to_pydict()
                before = zip(*(rows[n] for n in schema.names[2:])) if "s_length" in rows else None
                out = []
                for page, url in zip(rows["page_id"], rows["url"]):
                    site, pattern = judge(*host_and_path(url), index, rest, compiled)
                    old = next(before) if before else (None,) * 7
                    if old[0] is not None and (site is None or (old[0], -old[1]) > site[:2]):
                        site = (old[0], -old[1], old[2], old[3])
                    if old[4] is not None:  # of an earlier pass, so the first
                        pattern = old[4:]
                    out.append((page, url, *((site[0], -site[1], *site[2:]) if site else (None,) * 4),
                                *(pattern or (None,) * 3)))
                yield _batch(out, schema)

        frame = frame.mapInArrow(run, wide)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RESULT)
        for batch in batches:
            rows = batch.to_pydict()
            yield _batch([
                (page, *host_and_path(url), rule, verdict or other or "allow",
                 pattern if verdict is None else None)
                for page, url, rule, verdict, pattern, other in zip(*(
                    rows[n] for n in ("page_id", "url", "s_rule", "s_verdict", "p_rule", "p_verdict")))
            ], schema)

    return frame.mapInArrow(finish, RESULT)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def op3_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


_SQL_PATTERN = "case " + " ".join(
    "when regexp_matches(host || path, '{}') then '{}'".format(
        "(?s)^" + ".*".join(re.escape(p).replace("\\-", "-") for p in r.text.split("*")) + "$", r.text)
    for r in PATTERN_RULES
) + " end"

QUERIES = {"op3_filter_urls": op3_filter_urls}
SQL = {"op3_filter_urls": f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id,
    translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path
  from cut),
rules(rule, verdict, rule_host, rule_path) as (values
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
pairs as (select distinct host, path from parts),
best as (
  select host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as rule_verdict
  from pairs join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path),
judged as (
  select page_id, host, path, rule, rule_verdict,
    case when rule is null then {_SQL_PATTERN} end as pattern
  from parts left join best using (host, path))
select page_id, host, path, rule, pattern,
  coalesce(rule_verdict, case when pattern is not null then 'block' else 'allow' end) as verdict
from judged
"""}
