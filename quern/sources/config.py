"""Settings, dispatch rules and relevance judgements from YAML; all of them small and read on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Search:
    bm25_weight: float = 1.0
    vector_weight: float = 1.0
    rrf_k: int = 60
    collapse: str = "max"
    pre_fanout: int = 50
    query_prefix: str = "search_query: "

    def __post_init__(self) -> None:
        # a weight of zero stands for the default
        self.bm25_weight = self.bm25_weight or 1.0
        self.vector_weight = self.vector_weight or 1.0
        self.rrf_k = self.rrf_k or 60


@dataclass
class Chunking:
    size_tokens: int = 384
    overlap_tokens: int = 48
    size_chars: int = 3500
    document_prefix: str = "search_document: "


@dataclass
class Clustering:
    k: int = 10
    min_similarity: float = 0.5
    min_cluster_size: int = 3
    max_iters: int = 20
    center: bool = True
    labeler: str = "llm"


@dataclass
class Settings:
    tenant_id: str = "local"
    embedding_dim: int = 768
    search: Search = field(default_factory=Search)
    chunking: Chunking = field(default_factory=Chunking)
    clustering: Clustering = field(default_factory=Clustering)

    def validate(self) -> None:
        c, k, s = self.chunking, self.clustering, self.search
        checks = {
            "embedding_dim must be positive": self.embedding_dim > 0,
            "chunking.size_tokens must be positive": c.size_tokens > 0,
            "chunking.overlap_tokens must be in [0, size_tokens)": 0 <= c.overlap_tokens < c.size_tokens,
            "chunking.size_chars must be positive": c.size_chars > 0,
            "search weights must not be negative": s.bm25_weight >= 0 and s.vector_weight >= 0,
            "search.collapse must be max, sum or top3_avg": s.collapse in ("max", "sum", "top3_avg"),
            "clustering.k must be positive": k.k > 0,
            "clustering.min_similarity must be in (0, 1]": 0 < k.min_similarity <= 1,
            "clustering.min_cluster_size must be at least 2": k.min_cluster_size >= 2,
            "clustering.labeler must be llm, terms or off": k.labeler in ("llm", "terms", "off"),
        }
        wrong = [m for m, ok in checks.items() if not ok]
        if wrong:
            raise ValueError("; ".join(wrong))


def load_settings(text: str) -> Settings:
    """Settings with what a YAML text gives in place of defaults; unknown keys and values out of range raise ValueError."""
    import yaml

    def fill(kind, values: dict):
        known = {f.name: f for f in fields(kind)}
        if not isinstance(values, dict) or set(values) - set(known):
            raise ValueError(f"unknown settings: {sorted(set(values) - set(known)) if isinstance(values, dict) else values}")
        parts = {"search": Search, "chunking": Chunking, "clustering": Clustering}
        return kind(**{k: fill(parts[k], v or {}) if kind is Settings and k in parts else v for k, v in values.items()})

    out = fill(Settings, yaml.safe_load(text) or {})
    out.validate()
    return out


def load_rules(text: str) -> list[dict]:
    """Dispatch rules in their order: (rule_no, kind, hosts, fetcher). One matcher at most; none matches any host."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict) or set(data) - {"rules"}:
        raise ValueError("only the key `rules` is known")
    out = []
    for k, rule in enumerate(data.get("rules") or [], 1):
        if set(rule) - {"match", "fetcher"}:
            raise ValueError(f"rule {k}: unknown keys {sorted(set(rule) - {'match', 'fetcher'})}")
        match = rule.get("match") or {}
        if not rule.get("fetcher"):
            raise ValueError(f"rule {k}: a fetcher is needed")
        if "content_type" in match:
            raise ValueError(f"rule {k}: content_type can't be known before a fetch")
        if set(match) - {"host", "host_suffix", "host_in"}:
            raise ValueError(f"rule {k}: unknown matchers {sorted(match)}")
        given = [(n, v) for n, v in match.items() if v]
        if len(given) > 1:
            raise ValueError(f"rule {k}: use only one of host, host_suffix, host_in")
        kind, hosts = given[0] if given else ("any", [])
        out.append({"rule_no": k, "kind": kind, "hosts": [hosts] if isinstance(hosts, str) else list(hosts), "fetcher": rule["fetcher"]})
    return out


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["rule_no"], r["kind"], r["hosts"], r["fetcher"]) for r in rules], "rule_no int, kind string, hosts array<string>, fetcher string")


class RulesFile:
    """A file of dispatch rules, read again when it has changed; a change that can't be read leaves the last good rules. Calling it gives
    the table of rules, so it can stand where rules are asked for with each batch of jobs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.seen, self.error = spark, path, None, None
        self.rules: list[dict] = []
        self()
        if self.error is not None:
            raise self.error

    def __call__(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        try:
            at = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
            seen = (at.getModificationTime(), at.getLen())
            if seen != self.seen:
                self.rules = load_rules("\n".join(r["value"] for r in self.spark.read.text(self.path).collect()))  # a short file
                self.seen, self.error = seen, None
        except Exception as e:  # the last good rules hold
            self.error = e
        return rules_table(self.spark, self.rules)


def load_judgements(spark: SparkSession, text: str) -> DataFrame:
    """(query_id, query, url) of a judged query set; an empty set, query or list of relevant URLs raises ValueError."""
    import yaml

    queries = (yaml.safe_load(text) or {}).get("queries") or []
    if not queries:
        raise ValueError("no queries")
    rows = []
    for k, q in enumerate(queries):
        if not q.get("query"):
            raise ValueError(f"query {k + 1} is empty")
        if not q.get("relevant"):
            raise ValueError(f"query {k + 1} has no relevant documents")
        rows += [(k, q["query"], u) for u in q["relevant"]]
    return spark.createDataFrame(rows, "query_id int, query string, url string")
