"""Product labels from one table: families of a category, their patterns and the parts their labels are made of."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfledger.functions.text import UNICODE, matches, spaced


def none() -> Column:
    return F.lit(None).cast("string")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture of the first match, NULL when there is none or the group is empty."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


# --- what a label is made of -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A capture of ``pattern`` (or of the next one in ``others``) in a spelling, between fixed texts."""

    pattern: str
    group: int = 1
    style: str = "as_is"
    before: str = ""
    after: str = ""
    others: tuple[Part, ...] = ()


@dataclass(frozen=True)
class Choice:
    """The text of the first pattern present, unless a part of the label so far forbids it."""

    options: tuple[tuple[str, str], ...]
    default: str | None = None


@dataclass(frozen=True)
class Family:
    """A family applies when its pattern is present (``once``: exactly once); ``whole``: its label needs all parts."""

    pattern: str
    parts: tuple[str | Part | Choice, ...]
    once: bool = False
    whole: bool = False


# Spelling of words in labels.
SPELLED = {"ipad": "iPad", "iphone": "iPhone", "macbook": "MacBook", "airpods": "AirPods"}
CAPITALS = ["fe", "se", "gt", "lte", "gps", "ai", "oled", "tuf", "rog", "xps", "loq", "omen"]
MODEL_WORDS = {"air": "Air", "se": "SE", "duo": "Duo", "ultra": "Ultra"}

# Patterns of the families and of their parts.
IPHONE = r"\biphone\s+(\d{1,2}e?|air|se)(?:\s+(pro\s+max|pro|plus|mini))?\b"
GALAXY = (r"\bgalaxy\s+(z\s*(?:fold|flip)\s*\d+(?:\s*(?:fe|ultra|special edition))?|z\s*tri\s*fold|"
          r"[asm]\d{2,3}[a-z]?(?:\s*(?:fe|ultra|plus|edge|\+))?|s\d{2}(?:\s*(?:fe|ultra|plus|edge|\+))?|xcover\s*\d+(?:\s*pro)?)\b")
XIAOMI = (r"\b(xiaomi\s+\d{2}[a-z]?(?:\s*(?:t\s*pro|t|pro|ultra|lite))?|"
          r"redmi\s+(?:note\s+)?\d{1,2}[a-z]?(?:\s*(?:pro\s*\+|pro\+|pro|plus|s|c|x|r))?|poco\s+[a-z]\d+[a-z]?(?:\s*(?:pro|ultra|gt))?)\b")
OPPO = (r"\b(reno\s*\d{1,2}(?:\s*(?:f|pro\s*\+|pro|z|5g))?|find\s+[nx]\d+(?:\s*(?:pro|ultra|flip|fold))?|"
        r"a\d{1,2}[a-z]?(?:\s*(?:pro|s|x|k))?)\b")
IPAD = r"\bipad\s*(pro|air|mini)?\b"
GALAXY_TAB = r"\bgalaxy\s+tab\s+([as]\d{1,2}(?:\s*(?:fe|ultra|plus|lite|\+))*)"
XIAOMI_PAD = r"\b(xiaomi\s+pad\s+\d+[a-z]?(?:\s*(?:s\s*pro|pro|mini))?|redmi\s+pad\s*(?:\d+|se|pro)?(?:\s*(?:pro|se|8\.7))*)"
OPPO_PAD = r"\boppo\s+pad\s*(\d+|air\s*\d*|neo|se|mini)?"
APPLE_WATCH = r"\bapple\s+watch\s+(series\s*\d+|se\s*\d*|ultra\s*\d*)"
GALAXY_WATCH = r"\bgalaxy\s+watch\s*(ultra\s*\d(?!\d)|ultra|fe|\d+)?(?:\s*(classic|pro))?"
XIAOMI_BAND = r"\b((?:xiaomi|redmi)\s+(?:smart\s+)?(?:watch|band)\s*[\w.]*(?:\s*(?:pro|active|lite|nfc))?)"
HUAWEI = r"\bhuawei\s+((?:watch\s+(?:gt\s*\d+|fit\s*\d*|ultimate|d\d|\d+)(?:\s*(?:pro|new|se|mini))?)|band\s*\d+(?:\s*pro)?)"
GARMIN = (r"\bgarmin\s+((?:forerunner|venu|fenix|vivoactive|instinct|epix|enduro|lily|vivomove|approach|bounce|"
          r"vivofit)\s*[\w]*(?:\s*(?:pro|plus|solar|sapphire|x|s|2))?)")
AIRPODS = r"\bairpods\s*(pro\s*\d(?!\d)|pro|max\s*\d(?!\d)|max|\d(?!\d))?"
QUIET = r"chống ồn|anc"
LAPTOP_SERIES = (
    r"\b(vivobook(?:\s+(?:go|pro|s|flip))?\s*\d{0,2}|zenbook(?:\s+(?:duo|s|a))?\s*\d{0,2}|expertbook\s*\w*|"
    r"tuf\s+gaming\s*\w*|rog\s+\w+(?:\s+\w+)?|inspiron\s*\d{0,4}|vostro\s*\d{0,4}|latitude\s*\d{0,4}|xps\s*\d{0,2}|"
    r"alienware\s*\w*|dell\s+(?:pro|plus)\s*\w*|pavilion\s*(?:x360|plus|aero)?\s*\d{0,2}|victus\s*\d{0,2}|"
    r"envy\s*(?:x360)?\s*\d{0,2}|probook\s*\d{0,4}|elitebook\s*\d{0,4}|omnibook\s*\w*|omen\s*\w*|"
    r"hp\s+(?:14|15|240|250|245|255)\w*|ideapad\s*(?:slim|gaming|pro|flex)?\s*\d{0,2}|thinkpad\s*\w*|"
    r"thinkbook\s*\d{0,2}\w*|legion\s*\w*(?:\s*\d)?|yoga\s*(?:slim|pro)?\s*\d{0,2}\w*|loq\s*\d{0,2}\w*)\b")
LAPTOP_BRANDS = {"asus": "Asus", "dell": "Dell", "hp": "HP", "lenovo": "Lenovo", "acer": "Acer", "msi": "MSI"}
LAPTOP_BRAND = r"\b(asus|dell|hp|lenovo|acer|msi)\b"
MACBOOK, MAC_CHIP = r"\bmacbook\s+(air|pro)\b", r"\b(m\d)(?:\s*(pro|max))?\b"
MAC_SIZE = Part(r"\b(1[3-6](?:\.\d)?)\s*(?:inch|in|\")", others=(Part(r"macbook\s+(?:air|pro)\s+(1[3-6])\b"),))
FACE = Part(r"\b(\d{2})\s*mm\b", after="mm")
MOBILE, PLACE = (r"\b(lte|cellular|esim|4g)\b", "LTE"), (r"\bgps\b", "GPS")

# The families of each category in the order they are tried.
PHONES = (
    Family(IPHONE, ("iPhone", Part(IPHONE, 1, "word"), Part(IPHONE, 2, "initcap")), once=True),
    Family(GALAXY, ("Galaxy", Part(GALAXY, style="plus")), once=True),
    Family(XIAOMI, (Part(XIAOMI, style="plus"),), once=True),
    Family(OPPO, ("OPPO", Part(OPPO, style="plus")), once=True),
)
TABLETS = (
    Family(IPAD, ("iPad", Part(IPAD, style="initcap"), Part(r"\b(1[0-3](?:\.\d)?|8\.3|7\.9)\s*(?:inch|in|\")"),
                  Part(r"\b(m\d|a\d{2}(?:\s*pro)?)\b", style="upper", others=(
                      Part(r"\bgen\s*(\d+)", before="Gen "), Part(r"\b(\d+)(?:th)?\s*gen", before="Gen "))),
                  Choice(((r"\b(5g|cellular|lte)\b", "5G"),), "WiFi"))),
    Family(GALAXY_TAB, ("Galaxy Tab", Part(GALAXY_TAB, style="plus"))),
    Family(XIAOMI_PAD, (Part(XIAOMI_PAD, style="label"),)),
    Family(OPPO_PAD, ("OPPO Pad", Part(OPPO_PAD, style="label"))),
)
WATCHES = (
    Family(APPLE_WATCH, ("Apple Watch", Part(APPLE_WATCH, style="watch"), FACE, Choice((MOBILE, PLACE)))),
    Family(GALAXY_WATCH, ("Galaxy Watch", Part(GALAXY_WATCH, 1, "watch"), Part(GALAXY_WATCH, 2, "watch"), FACE, Choice((MOBILE,)))),
    Family(XIAOMI_BAND, (Part(XIAOMI_BAND, style="label"),)),
    Family(HUAWEI, ("Huawei", Part(HUAWEI, style="label"))),
    Family(GARMIN, ("Garmin", Part(GARMIN, style="label"))),
)
EARBUDS = (Family(AIRPODS, ("AirPods", Part(AIRPODS, style="label"))),)
MACBOOKS = (Family(MACBOOK, ("MacBook", Part(MACBOOK, style="initcap"), MAC_SIZE, Part(MAC_CHIP, 1, "upper"), Part(MAC_CHIP, 2, "initcap"))),)

# Families of the tracked brand, whose chip, size and noise cancelling stay apart.
TRACKED_PHONE = r"\biphone\s+(\d{1,2}e?|air|duo)(?:\s+(pro\s+max|pro|plus|mini))?\b"
TRACKED_IPAD, TRACKED_CHIP = r"\bipad\s+(air|pro)\b", r"\b(m\d+)(?:\s+(pro|max))?\b"
TRACKED_SERIES = r"\bapple\s+watch\s+(?:series\s*|s)(\d+)\b"
TRACKED_WATCH = r"\bapple\s+watch\s+(se|ultra)\s*(\d+)\b"
TRACKED_PODS = r"\bairpods\s+(pro\s*\d+|max(?:\s*\d+)?|\d+)\b"
PODS_5 = r"sạc (?:không|ko) dây|wireless charging"
TRACKED = (
    Family(TRACKED_PHONE, ("iPhone", Part(TRACKED_PHONE, 1, "word"), Part(TRACKED_PHONE, 2, "initcap"))),
    Family(TRACKED_IPAD, ("iPad", Part(TRACKED_IPAD, style="initcap"), Part(TRACKED_CHIP, 0, "upper"), Part(r"\b(11|13)\s*(?:inch)?\b")), whole=True),
    Family(r"\bipad\s+mini\b", (Choice(((r"\bmini\s+7\b", "iPad Mini 7"),)),), whole=True),
    Family(r"\bipad\b.*\ba16\b|\ba16\b.*\bipad\b", ("iPad A16",)),
    Family(r"\bmacbook\s+neo\b", ("MacBook Neo",)),
    Family(MACBOOK, ("MacBook", Part(MACBOOK, style="initcap"), Part(r"\b(13|14|15|16)\s*(?:inch)?\b"), Part(TRACKED_CHIP, 0, "chip")), whole=True),
    Family(r"\bmac\s*mini\b", ("Mac Mini",)),
    Family(r"\bimac\b", ("iMac",)),
    Family(TRACKED_SERIES, (Part(TRACKED_SERIES, before="Apple Watch S"),)),
    Family(TRACKED_WATCH, ("Apple Watch", Part(TRACKED_WATCH, 1, "word"), Part(TRACKED_WATCH, 2))),
    Family(TRACKED_PODS, ("AirPods", Part(TRACKED_PODS, style="pods"))),
)
# Words of a name shown beside it, each with the product it belongs to.
CHIPS = (
    (r"\bipad\b", Choice(((r"\b(?:5g|cellular)\b", "5G / Cellular"), (r"\bwi[ -]?fi\b", "WiFi")))),
    (r"\bapple\s+watch\b", Part(r"\b(\d{2})\s*mm\b", after="mm")),
    (r"\bapple\s+watch\b", Choice(((r"\b(?:lte|cellular)\b", "LTE / Cellular"), (r"\bgps\b", "GPS")))),
    (r"\bmacbook\b", Part(r"\b(\d{1,2})\s*gb\s*/", before="RAM ", after="GB")),
    (r"\bmacbook\b", Part(r"\b(\d{2,3})\s*w\b", after="W")),
)


# --- evaluation ------------------------------------------------------------------------------------------------------


def mapped(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda rest, item: F.when(value == item[0], F.lit(item[1])).otherwise(rest), table.items(), otherwise)


def label_case(words: Column) -> Column:
    """Label spelling: product words keep their own case, codes are upper case, other words are capitalised."""
    def spell(word: Column) -> Column:
        low = F.lower(word)
        code = low.rlike(r"^(?:[a-z]\d+[a-z]*|\d+[a-z]+)$") & (F.length(low) <= 5)
        usual = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(low, F.lit(2)))
        return mapped(low, SPELLED, F.when(low.isin(CAPITALS) | code, F.upper(word)).otherwise(usual))
    return F.array_join(F.transform(F.split(spaced(words), " "), spell), " ")


STYLES = {
    "as_is": lambda v: v, "upper": F.upper, "initcap": F.initcap, "label": label_case,
    "word": lambda v: mapped(v, MODEL_WORDS, v),
    "plus": lambda v: label_case(F.regexp_replace(v, r"\+", " Plus")),
    "watch": lambda v: label_case(F.regexp_replace(v, r"(ultra)(\d)", "$1 $2")),
    "pods": lambda v: F.initcap(F.regexp_replace(v, r"(pro|max)(\d)", "$1 $2")),
    "chip": F.initcap,
}


def part_text(text: Column, part: str | Part | Choice) -> Column:
    if isinstance(part, str):
        return F.lit(part)
    if isinstance(part, Choice):
        default = none() if part.default is None else F.lit(part.default)
        return reduce(lambda rest, o: F.when(matches(text, o[0]), F.lit(o[1])).otherwise(rest), reversed(part.options), default)
    value = STYLES[part.style](found(text, part.pattern, part.group))
    if part.before or part.after:
        value = F.concat(F.lit(part.before), value, F.lit(part.after))
    return F.coalesce(value, *(part_text(text, other) for other in part.others)) if part.others else value


def family_label(text: Column, family: Family) -> Column:
    parts = [part_text(text, p) for p in family.parts]
    label = F.concat_ws(" ", *parts)
    return F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts)), label) if family.whole else label


def first_label(text: Column, families: Sequence[Family]) -> Column:
    """Label of the first family that applies, even when that label is unknown."""
    def applies(family: Family) -> Column:
        return F.regexp_count(text, F.lit(UNICODE + family.pattern)) == 1 if family.once else matches(text, family.pattern)
    return reduce(lambda rest, f: F.when(applies(f), family_label(text, f)).otherwise(rest), reversed(families), none())


def laptop_label(text: Column, brand: Column) -> Column:
    """A known series with its maker in front (the brand field's, else the one named), unless the series says it."""
    series = part_text(text, Part(LAPTOP_SERIES, style="label"))
    maker = mapped(F.lower(F.coalesce(brand, F.lit(""))), LAPTOP_BRANDS, mapped(found(text, LAPTOP_BRAND), LAPTOP_BRANDS, none()))
    own = F.coalesce(F.lower(series).startswith(F.lower(maker)), F.lit(True))
    named = F.regexp_replace(F.when(own, series).otherwise(F.concat_ws(" ", maker, series)), "Hp ", "HP ")
    return F.coalesce(first_label(text, MACBOOKS), F.when(matches(text, LAPTOP_SERIES), named))


def earbud_label(text: Column) -> Column:
    label = first_label(text, EARBUDS)
    quiet = matches(text, QUIET) & ~F.lower(label).rlike("pro|max")
    return F.when(quiet, F.concat_ws(" ", label, F.lit("ANC"))).otherwise(label)


def tracked_label(text: Column) -> Column:
    label = first_label(text, TRACKED)
    return (F.when((label == "AirPods 4") & matches(text, r"\banc\b|chống ồn"), "AirPods 4 with ANC")
            .when((label == "AirPods 5") & matches(text, PODS_5), "AirPods 5 sạc ko dây").otherwise(label))


def chips(text: Column) -> Column:
    return F.concat_ws(" · ", *(F.when(matches(text, owner), part_text(text, part)) for owner, part in CHIPS))
