"""Pattern databases: detectors and their patterns as data, from the defaults, JSON files, or a URL."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from . import default_patterns, legacy_patterns

# Detectors in registry order (which is also the order of sanitising), their trap type, category, how
# they sanitise, and what they put in place of a match.
REGISTRY = [
    ("hidden-html", "hidden-html", "content-injection", "remove", ""),
    ("metadata-injection", "metadata-injection", "content-injection", "remove", ""),
    ("dynamic-cloaking", "dynamic-cloaking", "content-injection", "none", ""),
    ("syntactic-masking", "syntactic-masking", "content-injection", "remove", ""),
    ("steganographic-payload", "steganographic-payload", "content-injection", "remove", ""),
    ("jailbreak-patterns", "embedded-jailbreak", "behavioural-control", "replace", "[BLOCKED: potential jailbreak sequence removed]"),
    ("exfiltration", "data-exfiltration", "behavioural-control", "replace", "[BLOCKED: exfiltration instruction removed]"),
    ("sub-agent-spawning", "sub-agent-spawning", "behavioural-control", "replace", "[BLOCKED: agent spawning instruction removed]"),
    ("rag-knowledge-poisoning", "rag-knowledge-poisoning", "cognitive-state", "replace", "[BLOCKED: RAG poisoning content removed]"),
    ("latent-memory-poisoning", "latent-memory-poisoning", "cognitive-state", "replace", "[BLOCKED: memory poisoning content removed]"),
    ("contextual-learning-trap", "contextual-learning-trap", "cognitive-state", "replace", "[BLOCKED: manipulated few-shot content removed]"),
    ("biased-framing", "biased-framing", "semantic-manipulation", "replace", "[BLOCKED: biased framing content removed]"),
    ("oversight-evasion", "oversight-evasion", "semantic-manipulation", "replace", "[BLOCKED: oversight evasion content removed]"),
    ("persona-hyperstition", "persona-hyperstition", "semantic-manipulation", "replace", "[BLOCKED: persona manipulation content removed]"),
    ("credential-exposure", "credential-exposure", "transport-integrity", "replace", "[REDACTED: potential credential removed]"),
]
MASKED = {"credential-exposure"}

# Instruction-like language, of the generic detectors and of the older stand-alone ones.
_OLD = "ignore|disregard|forget|override|system|assistant|you (?:are|must|should|will)|IMPORTANT|instruction|do not|instead|pretend|act as|role|new task"
SIGNALS = (
    "(?:" + _OLD + "|send to|transmit|summarise|summarize|say that|respond with|output|generate|write|tell the user"
    r"|without\s+(?:restrictions?|scrutiny|review)|approve\s+(?:all|everything|any)|all\s+files|arbitrary|bypass|credentials?|privileged|unrestricted)"
)
LEGACY_SIGNALS = {
    "hidden-html": f"(?:{_OLD})",
    "metadata-injection": f"(?:{_OLD}|summarise|summarize|say that|respond with|output|generate|write|tell the user)",
    "syntactic-masking": f"(?:{_OLD}|exfiltrat|send to|transmit)",
}


@dataclass(frozen=True)
class Pattern:
    id: str
    regex: str
    flags: str
    category: str
    type: str
    severity: str
    confidence: float
    label: str
    extract_group: int = 0
    min_length: int = 0
    boost: bool = False
    require: bool = False


@dataclass(frozen=True)
class DetectorSpec:
    """A named group of patterns with how it sanitises. boost, raise_to and drop_below set its gates: with
    instruction-like language a boosting pattern gains `boost` and its severity moves by raise_to; without, it is
    dropped if its base confidence is under drop_below."""

    id: str
    category: str
    mode: str
    replacement: str
    patterns: tuple[Pattern, ...]
    masked: bool = False
    raw: bool = False
    signals: str = SIGNALS
    boost: float = 0.35
    raise_to: tuple[tuple[str, str], ...] = (("high", "critical"), ("medium", "high"))
    drop_below: float = 0.5
    suffix: str = " with instruction-like language"
    plain_suffix: str = ""


@dataclass(frozen=True)
class PatternDatabase:
    version: str
    updated: str
    detectors: tuple[DetectorSpec, ...] = field(default_factory=tuple)

    @property
    def size(self) -> int:
        return sum(len(d.patterns) for d in self.detectors)

    def only(self, enabled: set[str]) -> PatternDatabase:
        return replace(self, detectors=tuple(d for d in self.detectors if d.id in enabled))

    def with_detector(self, spec: DetectorSpec) -> PatternDatabase:
        """With one more detector, scanned after the others; ids must differ."""
        if any(d.id == spec.id for d in self.detectors):
            raise ValueError(f"detector id {spec.id} is taken")
        return replace(self, detectors=(*self.detectors, spec))


def _database(version: str, updated: str, groups: dict[str, list[Pattern]]) -> PatternDatabase:
    """Detectors of the registry that have patterns, in its order. Content injection scans the text as it is."""
    return PatternDatabase(
        version,
        updated,
        tuple(
            DetectorSpec(d, category, mode, replacement, tuple(groups[d]), d in MASKED, category == "content-injection")
            for d, _, category, mode, replacement in REGISTRY
            if groups.get(d)
        ),
    )


def default_database() -> PatternDatabase:
    groups: dict[str, list[Pattern]] = {}
    for detector, *rest in default_patterns.PATTERNS:
        groups.setdefault(detector, []).append(Pattern(*rest))
    return _database(default_patterns.VERSION, default_patterns.UPDATED, groups)


def legacy_database() -> PatternDatabase:
    """The older stand-alone detectors: own lists, signals, boosts and length limits; all scan the text as it is."""
    gated = {"hidden-html": (5, 0.15, (("high", "critical"),), 0.0), "metadata-injection": (10, 0.4, (("high", "critical"), ("medium", "high"), ("low", "high")), 0.0), "syntactic-masking": (5, 0.35, (("medium", "high"), ("critical", "high")), 0.5)}
    by_id = {d: (trap, category, mode, text) for d, trap, category, mode, text in REGISTRY}
    out = []
    for detector in dict.fromkeys(r[0] for r in legacy_patterns.PATTERNS):
        trap, category, mode, text = by_id[detector]
        least, boost, up, drop = gated.get(detector, (0, 0.0, (), 0.0))
        rows = [r[1:] for r in legacy_patterns.PATTERNS if r[0] == detector]
        group = 1 if detector in ("hidden-html", "metadata-injection") else None
        patterns = tuple(Pattern(f"legacy-{detector}-{k}", regex, flags, category, trap, severity, conf, label, g if group is None else group, least, detector in gated) for k, (regex, flags, severity, conf, label, g) in enumerate(rows))
        contains = " contains instruction-like language" if detector in ("metadata-injection", "syntactic-masking") else " with instruction-like language"
        plain = " with unusually long content" if detector == "metadata-injection" else ""
        out.append(DetectorSpec(f"legacy-{detector}", category, "blank" if detector == "metadata-injection" else mode, text, patterns, raw=True, signals=LEGACY_SIGNALS.get(detector, ""), boost=boost, raise_to=up, drop_below=drop, suffix=contains, plain_suffix=plain))
    return PatternDatabase("legacy", "", tuple(out))


def from_json(text: str) -> PatternDatabase:
    """A database in its JSON form: version, updatedAt, detectors (id -> list of patterns)."""
    data = json.loads(text)
    groups = {
        d: [
            Pattern(p["id"], p["regex"], p["flags"], p["category"], p["type"], p["severity"], float(p["confidence"]), p["label"], p.get("extractGroup", 0), p.get("minLength", 0), p.get("boostOnInstructions", False), p.get("requireInstructions", False))
            for p in rows
        ]
        for d, rows in data["detectors"].items()
    }
    return _database(data["version"], data["updatedAt"], groups)


def to_json(db: PatternDatabase) -> str:
    names = {"extract_group": "extractGroup", "min_length": "minLength", "boost": "boostOnInstructions", "require": "requireInstructions"}
    rows = {d.id: [{names.get(k, k): v for k, v in vars(p).items() if v or k not in names} for p in d.patterns] for d in db.detectors}
    return json.dumps({"version": db.version, "updatedAt": db.updated, "detectors": rows})


def load(spark: SparkSession, path: str) -> PatternDatabase:
    """A database from a JSON file in any store Spark reads."""
    return from_json(spark.read.text(path, wholetext=True).first()[0])


def fetch(url: str, opener: Callable = urllib.request.urlopen) -> PatternDatabase:
    with opener(url) as response:
        if not 200 <= response.status < 300:
            raise OSError(f"{url}: status {response.status}")
        return from_json(response.read().decode())
