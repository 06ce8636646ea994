"""Names of body parts, feature columns, files and segments: plain functions over schemas, and the same as column expressions where rows hold names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: Words that body-part names are made of; longer ones are tried first.
PART_WORDS = (
    "left", "right", "fore", "hind", "front", "back", "mid", "upper", "lower", "dorsal", "ventral", "shoulder", "elbow", "center", "centre", "snout", "muzzle", "rostrum", "wrist", "ankle", "spine", "shank", "trunk", "belly", "flank", "digit", "mouth", "rump", "limb", "nose", "head",
    "tail", "base", "body", "ear", "paw", "hip", "leg", "jaw", "eye", "tip", "neck", "hand", "foot", "knee", "toe",
)
#: Words that mean the same part.
SYNONYMS = {"body": "trunk", "back": "trunk", "spine": "trunk", "dorsal": "trunk", "mid": "center", "middle": "center", "centre": "center", "centroid": "center", "snout": "nose", "tailbase": "tail_base", "l": "left", "r": "right"}
#: Statistics that a segment column's name may end with.
STATS = ("mean", "std", "median", "min", "max", "p10", "p90", "energy", "periodicity", "delta", "trend")
#: Parts of column names that tell a family.
VIDEO, KINEMATICS, CONTEXT_WORDS, CONTEXT_PARTS = ("flow", "surface", "r3d", "optical", "video", "pixel", "texture", "local"), ("velocity", "speed", "accel", "jerk", "displacement", "distance", "angularvel", "momentum"), ("roi", "zone", "arena", "wall", "corner", "env"), ("target", "occup")
FAMILIES = ("pose", "kinematics", "video", "context", "social")
#: Spellings of "none of the behaviours".
NEGATIVE = ("no_behavior", "no_behaviour", "nobehavior", "nobehaviour")
_WORDS = "|".join(sorted(PART_WORDS, key=len, reverse=True))
#: Where a name is cut: between a small letter or digit and a capital, and between letters and digits.
_EDGES = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def part_name(name: str) -> str:
    """One spelling for a body part: lower case, words apart (LeftEar, leftear and left-ear are left_ear; spine1 is spine_1)."""
    pieces = re.split(r"[_\s-]+", re.sub(_EDGES, "_", name).lower())
    return "_".join(re.sub(rf"^((?:{_WORDS})*)(.*)$", lambda m: "_".join([*re.findall(_WORDS, m[1]), *([m[2]] if m[2] else [])]), p) for p in pieces if p)


def part_name_column(name: Column) -> Column:
    """part_name of a column."""
    pieces = F.filter(F.split(F.lower(F.regexp_replace(name, _EDGES, "_")), r"[_\s-]+"), lambda p: p != "")
    known = lambda p: F.regexp_extract(p, rf"^((?:{_WORDS})*)", 1)
    rest = lambda p: F.substring(p, F.length(known(p)) + 1, F.length(p))
    apart = F.transform(pieces, lambda p: F.concat(F.regexp_replace(known(p), rf"({_WORDS})", "$1_"), rest(p)))
    return F.regexp_replace(F.regexp_replace(F.array_join(apart, "_"), r"_+", "_"), r"^_|_$", "")


def part_tokens(name: str) -> frozenset[str]:
    return frozenset(SYNONYMS.get(t, t) for t in part_name(name).split("_") if t)


def part_similarity(a: str, b: str) -> float:
    """Jaccard of the words, synonyms taken as one."""
    x, y = part_tokens(a), part_tokens(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def suggest_parts(model: list[str], data: list[str], least: float = 0.5) -> dict[str, str]:
    """For each of model the part of data it stands for, or "": equal names first, then in order the most similar one still free, of `least` at least."""
    by_name = {part_name(d): d for d in data}
    out: dict[str, str] = {}
    for m in model:
        same = by_name.get(part_name(m))
        if same is not None and same not in out.values():
            out[m] = same
    for m in (m for m in model if m not in out):
        free = [d for d in data if d not in out.values()]
        top = max(free, key=lambda d: part_similarity(m, d), default="")
        out[m] = top if top and part_similarity(m, top) >= max(least, 1e-12) else ""
    return {m: out[m] for m in model}


def rename_parts(parts: Iterable[str], aliases: dict[str, str]) -> dict[str, str]:
    """{old: new} of the aliases that apply: neither empty nor equal, the old one there and the new one not."""
    there, out = set(parts), {}
    for old, new in aliases.items():
        if old in there and new and new != old and new not in there:
            out[old] = new
            there = there - {old} | {new}
    return out


def rename_tokens(columns: Iterable[str], parts: dict[str, str]) -> dict[str, str]:
    """{old column: new} where parts are renamed; a part is met where no letter touches it, longer parts first."""
    if not parts:
        return {}
    found = re.compile("(?<![a-z])(" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + ")(?![a-z])")
    return {c: new for c in columns if (new := found.sub(lambda m: parts[m[1]], c)) != c}


def distance_name(column: str) -> str:
    """dist_a_to_b in one spelling: ends sorted, `_norm` and a statistic kept behind; other columns as they are."""
    m = re.fullmatch(r"dist_((?:(?!_to_).)+)_to_((?:(?!_to_).)+?)(_norm)?((?:_(?:" + "|".join(STATS) + "))?)", column)
    if not m:
        return column
    a, b = sorted(m.group(1, 2))
    return f"dist_{a}_to_{b}{m[3] or ''}{m[4]}"


def distance_name_column(column: Column) -> Column:
    pattern = r"^dist_((?:(?!_to_).)+)_to_((?:(?!_to_).)+?)((?:_norm)?(?:_(?:" + "|".join(STATS) + "))?)$"
    a, b = F.regexp_extract(column, pattern, 1), F.regexp_extract(column, pattern, 2)
    return F.when(column.rlike(pattern), F.concat(F.lit("dist_"), F.least(a, b), F.lit("_to_"), F.greatest(a, b), F.regexp_extract(column, pattern, 3))).otherwise(column)


def target_class(labels: dict[int, str], target: str) -> int | None:
    """The class of target: by its label, by its label in plain words, else the only class that is not negative."""
    plain = lambda x: re.sub(r"[^a-z0-9]+", "_", str(x or "").strip().lower()).strip("_")
    tests = (lambda x: x == target, lambda x: bool(plain(target)) and plain(x) == plain(target))
    for test in tests:
        for k, v in labels.items():
            if test(str(v)):
                return int(k)
    positive = [int(k) for k, v in labels.items() if plain(v) not in NEGATIVE]
    return positive[0] if len(positive) == 1 else None


def excluded(columns: Iterable[str], explicit: Iterable[str], patterns: Iterable[str]) -> set[str]:
    """Columns that are named, or that hold a pattern of a group that is off."""
    named, parts = set(explicit), list(patterns)
    return {c for c in columns if c in named or any(p in c for p in parts)}


def family(column: str) -> str:
    """social, video, context, kinematics or pose, in this order of precedence, by the words of a column's name."""
    name = column.lower()
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if name.startswith("social_"):
        return "social"
    if any(k in w for w in words for k in VIDEO):
        return "video"
    if any(k in w for w in words for k in CONTEXT_PARTS) or any(re.fullmatch(rf"(?:{'|'.join(CONTEXT_WORDS)})\d*", w) for w in words):
        return "context"
    return "kinematics" if any(k in w for w in words for k in KINEMATICS) else "pose"


def family_column(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.startswith("social_"), "social").when(low.rlike("|".join(VIDEO)), "video").when(low.rlike("|".join(CONTEXT_PARTS)) | low.rlike(rf"(^|[^a-z0-9])({'|'.join(CONTEXT_WORDS)})[0-9]*([^a-z0-9]|$)"), "context").when(low.rlike("|".join(KINEMATICS)), "kinematics").otherwise("pose")
    )


def select_features(columns: Iterable[str], video: bool = False, social: bool = False, context: bool = False, embeddings: bool | None = None) -> list[str]:
    """Pose and kinematics, then context, video and social where asked for; embeddings (r3d) go with video unless told apart."""
    columns = list(columns)
    of = lambda *kinds: [c for c in columns if family(c) in kinds]
    deep = lambda c: "r3d" in c.lower()
    pictures = of("video") if video else []
    if embeddings is not None:
        pictures = [c for c in pictures if not deep(c)] + ([c for c in of("video") if deep(c)] if embeddings else [])
    return of("pose", "kinematics") + (of("context") if context else []) + pictures + (of("social") if social else [])


def match_key(stem: Column) -> Column:
    """What a video's and a pose file's stem share: cut at a video extension that ends a word, else at `dlc_`, else a known ending goes."""
    s = F.lower(stem)
    clean = lambda c: F.regexp_replace(c, r"[_\- .]+$", "")
    video, tracked, ending = r"^(.+?)\.(?:mp4|avi|mov|mkv)(?![a-z0-9]).*$", r"^(.+?)dlc_.*$", r"^(.+)_(?:dlc|pose|tracking|tracked|labeled)$"
    out = s
    for pattern in (ending, tracked, video):
        out = F.when(s.rlike(pattern), clean(F.regexp_extract(s, pattern, 1))).otherwise(out)
    return out


def extract_name(stem: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, null where there is none or it is blank; a pattern that is none gives null."""
    try:
        if re.compile(pattern).groups < group:
            return F.lit(None).cast("string")
    except re.error:
        return F.lit(None).cast("string")
    return F.nullif(F.trim(F.regexp_extract(stem, pattern, group)), F.lit(""))


def segment_frames(segment_id: Column) -> tuple[Column, Column]:
    """start and end of an id that ends with _start_end, else nulls."""
    return tuple(F.nullif(F.regexp_extract(segment_id, r"_(\d+)_(\d+)$", k), F.lit("")).cast("long") for k in (1, 2))


def segment_interval(segment_id: Column) -> tuple[Column, Column, Column]:
    """(session, start, end): ids of four words or more, with a word `session` before another and two numbers at the end; else nulls."""
    words = F.split(segment_id, "_")
    start, end = segment_frames(segment_id)
    name = F.regexp_extract(segment_id, r"(?:^|_)session_([^_]+)(?=_)", 1)
    good = (F.size(words) >= 4) & (name != "") & start.isNotNull()
    return F.when(good, F.concat(F.lit("session_"), name)), F.when(good, start), F.when(good, end)


def sheet_names(subjects: Iterable[str]) -> list[str]:
    """Distinct names of sheets: 31 characters, without []:*?/\\, numbered where they would be equal but for case."""
    used: set[str] = set()
    out = []
    for s in subjects:
        base = re.sub(r"[\[\]:*?/\\]", "_", s.strip()).strip() or "subject"
        name, k = base[:31], 1
        while name.lower() in used:
            k += 1
            name = f"{base[: 31 - len(f'_{k}')]}_{k}"
        used.add(name.lower())
        out.append(name)
    return out
