"""Column builders for class scores, score tiers and quantised model output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class groups, tier names and device state codes as they appear in the data.
POSITIVE_CLASSES = ["baby_cry_infant", "crying_sobbing", "whimper", "wail_moan", "screaming"]
CONFOUNDER_CLASSES = ["speech", "child_speech", "babbling", "baby_laughter", "giggle"]
SCORED_CLASSES = {
    14: "baby_laughter", 19: "crying_sobbing", 20: "baby_cry_infant", 0: "speech",
    1: "child_speech", 4: "babbling", 11: "screaming", 13: "laughter",
}
TIERS = ["high_pos", "high_neg", "medium_pos", "medium_neg", "low"]
ELIGIBLE_TIERS = ["high_pos", "high_neg"]
STATE_NAMES = ["boot", "connecting", "syncing", "idle", "crying", "error"]
WATCHED_INDEX = [20, 19, 21, 22, 0, 1, 13, 14, 15, 65, 70, 78, 42, 44, 371, 406, 11, 389, 390, 393]
WATCHED_NAMES = [
    "cry_baby", "cry_adult", "whimper", "wail_moan", "speech", "child_speech", "laughter", "baby_laughter", "giggle",
    "hubbub", "dog_bark", "meow", "cough", "sneeze", "vacuum", "fan", "scream", "alarm_clock", "siren", "smoke_alarm",
]


def safe_double(col: Column, default: float | None = None) -> Column:
    """Text to double; blank or junk text gives the default."""
    value = col.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def group_peak(columns: Sequence[Column]) -> Column:
    """Largest score of a class group; a class that was never scored counts as zero."""
    return F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in columns])


def group_scores(positive: Sequence[Column], confounder: Sequence[Column]) -> dict[str, Column]:
    pos, neg = group_peak(positive), group_peak(confounder)
    return {
        "pos_max": pos,
        "neg_max": neg,
        "pos_score": clip(pos, 0.0, 1.0),
        "neg_score": clip(neg, 0.0, 1.0),
        "purity": pos - neg,
    }


def _present(scores: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(s.isNotNull(), 1).otherwise(0) for s in scores])


def score_spread(scores: Sequence[Column]) -> Column:
    """Largest minus smallest of the scores present; null when there is none."""
    if len(scores) == 1:
        return scores[0] - scores[0]
    return F.greatest(*scores) - F.least(*scores)


def score_consensus(scores: Sequence[Column]) -> Column:
    """Mean of the scores present; null when there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    return F.try_divide(total, _present(scores))


def confidence_tier(scores: Sequence[Column]) -> Column:
    """Five tiers from the spread and mean of up to any number of independent scores."""
    spread, mean = score_spread(scores), score_consensus(scores)
    return (
        F.when((spread < 0.2) & (mean >= 0.7), "high_pos")
        .when((spread < 0.2) & (mean <= 0.1), "high_neg")
        .when((spread < 0.4) & (mean >= 0.4), "medium_pos")
        .when((spread < 0.4) & (mean < 0.4), "medium_neg")
        .otherwise("low")
    )


def note_agreement(note_label: Column, tier: Column, feature_score: Column) -> Column:
    """Does the human note agree with the tier? Null without a claim or without a feature score."""
    verdict = F.when(feature_score.isNotNull(), tier.isin("high_pos", "medium_pos"))
    return F.when(note_label.isin("cry", "not_cry"), (note_label == "cry") == verdict)


def is_eligible(tier: Column) -> Column:
    return tier.isin(*ELIGIBLE_TIERS)


def training_label(score: Column, high: float = 0.5, low: float = 0.1) -> Column:
    """1 from ``high`` up, 0 below ``low``, null between."""
    return F.when(score >= high, 1).when(score < low, 0)


def quantise(values: Column, scale: float, zero_point: int, half_even: bool = True) -> Column:
    """Float array to int8 codes. Host tools round half to even, the device half away from zero."""
    if half_even:
        code = lambda x: F.bround(x.cast("double") / scale + zero_point, 0)
    else:
        code = lambda x: F.round(x.cast("double") / scale, 0) + zero_point
    return F.transform(values, lambda x: clip(code(x), -128.0, 127.0).cast("tinyint"))


def dequantise(codes: Column, scale: float, zero_point: int) -> Column:
    return F.transform(codes, lambda q: (q.cast("int") - zero_point) * F.lit(float(scale)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def inverse_sigmoid(p: Column) -> Column:
    """Undo a squashed score scale; null outside the open unit interval."""
    return F.when((p > 0) & (p < 1), F.ln(p / (F.lit(1.0) - p)))


def softmax_mass(logits: Column, class_positions: Sequence[int]) -> Column:
    """Probability mass of the chosen zero-based classes after a max-shifted softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    chosen = reduce(lambda a, b: a + b, [F.exp(F.get(logits, F.lit(i)) - top) for i in class_positions])
    return F.try_divide(chosen, total)


def state_name(code: Column) -> Column:
    """Device state code to its name."""
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STATE_NAMES]), code.cast("int")), F.lit("unknown"))


def hz_to_mel(hz: Column, log10_form: bool = False) -> Column:
    """The device uses 1127 ln(1+f/700), the viewer 2595 log10(1+f/700)."""
    if log10_form:
        return 2595.0 * F.log10(1.0 + hz / 700.0)
    return 1127.0 * F.ln(1.0 + hz / 700.0)


def mel_to_hz(mel: Column, log10_form: bool = False) -> Column:
    if log10_form:
        return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)
    return 700.0 * (F.exp(mel / 1127.0) - 1.0)


def top_classes(scores: Column, k: int) -> Column:
    """The k best (idx, score) pairs, best first; equal scores keep the lower index."""
    pairs = F.transform(scores, lambda x, i: F.struct(x.cast("double").alias("score"), (-i).alias("neg")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(best, lambda p: F.struct((-p["neg"]).alias("idx"), p["score"].alias("score")))


def warning_scores(cry: Sequence[Column], joy: Sequence[Column], confounders: Sequence[Column], primary: Column) -> dict[str, Column]:
    """Merged cry score, its margin over laughter-like classes and the primary score less the worst confounder."""
    spectrum = F.greatest(*cry)
    return {
        "spectrum": spectrum,
        "joy_margin": spectrum - F.greatest(*joy),
        "net_primary": primary - F.greatest(*confounders),
    }


def watched_map(values: Column) -> Column:
    """Positional watched-class array to a name -> value map."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in WATCHED_NAMES]), F.slice(values, 1, len(WATCHED_NAMES)))


def ablate(scores: dict[str, Column], disabled: Sequence[str]) -> list[Column]:
    """Score list with the named scores switched off."""
    return [F.lit(None).cast("double") if name in disabled else col for name, col in scores.items()]
