"""Column builders for capture names, log names, notes, paths and times kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns, note words, category folders and allowed path roots of the data format.
LOG_NAME_PATTERNS = [
    r"^infer-\d{8}\.jsonl$",
    r"^cry-\d{8}\.log$",
    r"^infer-boot\.jsonl$",
    r"^CRY-\d{4}\.LOG$",
]
DAY_LOG_PATTERN = r"^(infer-\d{8}\.jsonl|cry-\d{8}\.log)$"
TEST_NOTES = ["capacity-test", "verify-round-2", "test-get-alias"]
CATEGORY_FOLDERS = {"wav": "wavs", "infer_log": "infer", "session_marker": "markers"}
DEFAULT_FOLDER = "misc"
PATH_ROOTS = ["/sdcard", "/logs", "/yamnet"]
ERA_BOUNDS = [("2026-04-22", "broken (double-sigmoid bug)"), ("2026-04-23", "sigmoid-fix only")]
LAST_ERA = "mel-fix (full)"


def _group(col: Column, pattern: str, idx: int) -> Column:
    return F.regexp_extract(col, pattern, idx)


def capture_instant(name: Column) -> Column:
    """Capture file name to an instant; null unless it holds a full date, time and zone offset."""
    pattern = r"^(?:cry-)?(\d{8}T\d{6})([+-]\d{2}):?(\d{2})(?:\.wav)?$"
    text = F.concat(_group(name, pattern, 1), _group(name, pattern, 2), _group(name, pattern, 3))
    return F.when(name.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssXX")))


def capture_iso(name: Column) -> Column:
    """Capture file name to ISO text in its own zone; null for names without a clock time."""
    plus = r"^cry-([^+]{8})T([^+]{6})\+([^+]*?)(?:\.wav)?$"
    minus = r"^cry-([^+]{8})T([^+-]{6})-([^+-]*?)(?:\.wav)?$"

    def iso(pattern: str, sign: str) -> Column:
        d, t, z = (_group(name, pattern, i) for i in (1, 2, 3))
        return F.concat(
            F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"),
            F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2),
            F.lit(sign), F.substring(z, 1, 2), F.lit(":"), F.substring(z, 3, 10),
        )

    return F.when(name.rlike(plus), iso(plus, "+")).when(name.rlike(minus), iso(minus, "-"))


def local_date(iso: Column) -> Column:
    """Date as written, never shifted to another zone; '?' for a blank time."""
    return F.when(F.length(F.coalesce(iso, F.lit(""))) > 0, F.substring(iso, 1, 10)).otherwise("?")


def local_hour(iso: Column) -> Column:
    return F.substring(iso, 12, 2).try_cast("int")


def rfc3339(ts: Column) -> Column:
    """Instant to text with milliseconds and offset in the session zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def firmware_era(iso: Column, bounds: list[tuple[str, str]] | None = None, last: str = LAST_ERA) -> Column:
    """Era of the first bound the capture date does not pass, by string order."""
    day = F.substring(iso, 1, 10)
    out = F.when(F.length(F.coalesce(iso, F.lit(""))) == 0, F.lit(None).cast("string"))
    for bound, era in bounds or ERA_BOUNDS:
        out = out.when(day <= bound, era)
    return out.otherwise(last)


def percent_decode(text: Column) -> Column:
    """Percent decoding that keeps '+' and leaves malformed escapes as they stand."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def note_text(note: Column) -> Column:
    raw = F.coalesce(note, F.lit(""))
    decoded = F.regexp_replace(percent_decode(raw), r"^\s+|\s+$", "")
    return F.when(raw.startswith("auto-rms-"), raw).otherwise(decoded)


def note_label(note: Column) -> Column:
    """What a free-text trigger note claims: cry, not_cry, test, auto or nothing."""
    raw = F.coalesce(note, F.lit(""))
    low = F.lower(note_text(note))
    claims_cry = low.rlike(r"^cry\d*$") | low.contains("cry ") | low.endswith(" cry") | low.contains("cry%20")
    return (
        F.when(raw == "", "")
        .when(raw.startswith("auto-rms-"), "auto")
        .when(claims_cry, "cry")
        .when(low.contains("quiet"), "not_cry")
        .when(low.isin(*TEST_NOTES), "test")
        .otherwise("")
    )


def auto_note(ratio: Column, rms: Column) -> Column:
    """Note text an automatic trigger writes: how far over the floor, and the level."""
    return F.concat(
        F.lit("auto-rms-"), F.format_string("%.0f", F.bround(ratio, 0)), F.lit("x-rms"), F.format_string("%.0f", F.bround(rms, 0))
    )


def auto_note_ratio(note: Column) -> Column:
    return _group(note, r"^auto-rms-(\d+)x-rms(\d+)$", 1).try_cast("bigint")


def auto_note_rms(note: Column) -> Column:
    return _group(note, r"^auto-rms-(\d+)x-rms(\d+)$", 2).try_cast("bigint")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mirror_path(path: Column, category: Column) -> Column:
    """Where a device file is kept in the mirror, by category."""
    folder = F.create_map(*[F.lit(x) for pair in CATEGORY_FOLDERS.items() for x in pair])
    return F.concat(F.coalesce(folder[category], F.lit(DEFAULT_FOLDER)), F.lit("/"), file_name(path))


def is_known_log(name: Column) -> Column:
    return name.rlike("|".join(LOG_NAME_PATTERNS))


def is_day_log(name: Column) -> Column:
    return name.rlike(DAY_LOG_PATTERN)


def log_day(name: Column) -> Column:
    """Day in a log name, for years 2020 to 2100; null when there is none."""
    digits = _group(name, r"^[^-]*-(\d{8})", 1)
    day = F.try_to_date(digits, "yyyyMMdd")
    return F.when((F.year(day) >= 2020) & (F.year(day) <= 2100), day)


def day_ordinal(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def is_safe_path(path: Column) -> Column:
    """Absolute, below an allowed root, and free of '..' and backslashes."""
    roots = "|".join(PATH_ROOTS)
    return F.coalesce(
        path.rlike(rf"^({roots})(/.*)?$") & ~path.contains("..") & ~path.contains("\\"), F.lit(False)
    )


def json_text(line: Column, key: str, max_chars: int) -> Column:
    """A quoted string field of a JSON line; null when missing, unquoted or longer than the field holds."""
    value = F.regexp_extract(line, rf'"{key}": *"([^"]*)"', 1)
    found = line.rlike(rf'"{key}": *"[^"]*"')
    return F.when(found & (F.length(value) < max_chars), value)


def json_unsigned(line: Column, key: str) -> Column:
    return F.when(
        line.contains(f'"{key}":'), F.coalesce(F.regexp_extract(line, rf'"{key}": *(\d+)', 1).try_cast("bigint"), F.lit(0))
    )


def sha256_hex(content: Column, chars: int = 64) -> Column:
    return F.left(F.sha2(content, 256), F.lit(chars))


def resume_offset(partial: Column, remote: Column) -> Column:
    """Byte to resume a transfer at; a partial larger than the remote file starts over."""
    size = F.coalesce(partial, F.lit(0))
    return F.when(size > remote, 0).otherwise(size)
