"""Optional model scoring: WordPiece encoding, a scorer plug-in, and threats from label probabilities."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .preparation import LABELS

log = logging.getLogger(__name__)
FAMILIES = {"content-injection": LABELS[:4], "behavioural-control": LABELS[4:7], "cognitive-state": LABELS[7:10], "semantic-manipulation": LABELS[10:13]}


class ModelError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class WordPiece:
    """Lower-cased greedy longest-match pieces with ## continuations."""

    def __init__(self, vocabulary: dict[str, int], length: int = 512):
        missing = [t for t in ("[CLS]", "[SEP]", "[UNK]", "[PAD]") if t not in vocabulary]
        if missing:
            raise ModelError("TOKENIZER_INVALID", f"vocabulary lacks {missing}")
        self.vocabulary, self.length = vocabulary, length

    @classmethod
    def from_json(cls, text: str, length: int = 512) -> WordPiece:
        data = json.loads(text)
        vocabulary = (data.get("model") or {}).get("vocab")
        if not vocabulary:
            raise ModelError("TOKENIZER_INVALID", "no vocabulary")
        return cls({**vocabulary, **{t["content"]: t["id"] for t in data.get("added_tokens", [])}}, length)

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                found = self.vocabulary.get(("##" if at else "") + word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return [self.vocabulary["[UNK]"]]
        return out

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """ids and mask, `length` long, always closed by [SEP]."""
        ids = [self.vocabulary["[CLS]"], *(i for w in text.lower().split() for i in self.pieces(w))][: self.length - 1]
        ids.append(self.vocabulary["[SEP]"])
        rest = self.length - len(ids)
        return ids + [self.vocabulary["[PAD]"]] * rest, [1] * len(ids) + [0] * rest


def with_logits(df: DataFrame, text_col: str, scorer: Callable[[list[str]], list[list[float] | None]], batch: int = 32) -> DataFrame:
    """df with logits from scorer(texts), called on the executors for `batch` texts at a time. A
    text on which it raises has null logits and the message in scorer_error."""

    @F.pandas_udf("struct<logits:array<float>,error:string>")
    def score(texts: pd.Series) -> pd.DataFrame:
        out: list = []
        for at in range(0, len(texts), batch):
            some = [t or "" for t in texts[at : at + batch]]
            try:
                out += [(x, None) for x in scorer(some)]
            except Exception:  # a model may raise anything; the texts that make it do so are found one by one
                out += [_alone(scorer, t) for t in some]
        return pd.DataFrame(out, columns=["logits", "error"])

    return df.withColumn("_score", score.asNondeterministic()(F.col(text_col))).withColumns({"logits": F.col("_score.logits"), "scorer_error": F.col("_score.error")}).drop("_score")


def _alone(scorer: Callable, text: str) -> tuple[list[float] | None, str | None]:
    try:
        return scorer([text])[0], None
    except Exception as error:
        return None, f"{type(error).__name__}: {error}"


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "critical").when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium").otherwise("low")


def label_threats(text: Column, logits: Column, threshold: float = 0.5) -> Column:
    """Threats of all labels but benign whose probability reaches the threshold; null logits give none."""
    category = F.create_map(*[F.lit(x) for family, names in FAMILIES.items() for n in names for x in (n, family)])
    names = F.array(*map(F.lit, LABELS))
    scored = F.transform(logits, lambda x, i: F.struct(F.get(names, i).alias("type"), (1 / (1 + F.exp(-x.cast("double")))).alias("confidence")))
    chosen = F.filter(scored, lambda s: (s["type"] != "benign") & (s["confidence"] >= threshold))
    return F.coalesce(
        F.transform(
            chosen,
            lambda s: F.struct(
                F.element_at(category, s["type"]).alias("category"), s["type"].alias("type"), severity(s["confidence"]).alias("severity"), s["confidence"].alias("confidence"),
                F.concat(F.lit("Classifier label "), s["type"]).alias("description"), F.left(text, F.lit(200)).alias("evidence"),
                F.lit(None).cast("struct<offset:int,length:int>").alias("location"), F.lit("ml-classifier").alias("detector_id"), F.lit(None).cast("string").alias("pattern_id"), F.lit("ml").alias("source"),
            ),
        ),
        F.array().cast("array<struct<category:string,type:string,severity:string,confidence:double,description:string,evidence:string,location:struct<offset:int,length:int>,detector_id:string,pattern_id:string,source:string>>"),
    )


def available(load: Callable[[], Callable], policy: str = "warn-and-skip") -> Callable | None:
    """The scorer that load() gives; if it fails: raise, warn and go without, or silently go without."""
    try:
        return load()
    except ModelError:
        if policy == "throw":
            raise
        if policy == "warn-and-skip":
            log.warning("model is not available; going on without it", exc_info=True)
        return None


def integrity_problems(files: DataFrame, expected_digest: str, model_labels: list[str], tokenizer: str = "tokenizer.json", model: str = "model.onnx", least_tokenizer: int = 100_000) -> DataFrame:
    """Problems of model files read as binaryFile (path, length, content): missing, digest, size; and label order."""
    spark = files.sparkSession
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    wanted = spark.createDataFrame([(tokenizer,), (model,)], "name string")
    problems = wanted.join(seen, "name", "left").select(
        "name",
        F.when(F.col("length").isNull(), "missing")
        .when((F.col("name") == model) & (F.col("digest") != expected_digest) & (not expected_digest.startswith("PLACEHOLDER")), "digest differs")
        .when((F.col("name") == tokenizer) & (F.col("length") < least_tokenizer), "too small")
        .alias("problem"),
    )
    wrong = [(f"label {k}", "differs") for k, (a, b) in enumerate(zip(model_labels + [""] * len(LABELS), LABELS, strict=False)) if a != b]
    labels = spark.createDataFrame(wrong, "name string, problem string")
    return problems.where("problem IS NOT NULL").unionByName(labels)
