"""Text cleaning as column expressions, and the same tables for other SQL engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and what they become.
ACCENTS = {
    "à": "a", "è": "e", "ì": "i", "ò": "o", "ù": "u",
    "â": "a", "ê": "e", "ô": "o", "î": "i", "û": "u",
    "ã": "a", "ñ": "n", "ō": "o", "ē": "e", "ń": "n", "é": "e",
    "ä": "a", "ë": "e", "ï": "i", "ö": "o", "ü": "u",
    "æ": "a", "œ": "o", "č": "c", "ŭ": "u", "å": "a", "ø": "o", "ç": "c", "ß": "s",
}
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "„“”"
APOSTROPHES = "'’‘`´ʹʻʼʽʿˈ"
DASHES = {"–": "-", "-": "-"}
CYRILLIC = {"a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "h": "х", "z": "ц"}
CYRILLIC_GROUPS = {"ch": "ч", "sh": "ш", "you": "ю", "ja": "я", "th": "д"}
DECOMPOSED = {"ä": "ä", "ü": "ü", "ö": "ö", "Ä": "Ä", "Ü": "Ü", "Ö": "Ö"}

#: White space as Python's ``\s`` has it; Java's lacks some of these.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


@dataclass(frozen=True)
class Cleaner:
    """Replacements in order, then single letters in one pass, then white space to one space."""

    name: str
    letters: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=lambda: DECOMPOSED)
    lower_first: bool = False

    def __call__(self, text: Column) -> Column:
        if self.lower_first:
            text = F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))
        for old, new in self.groups.items():
            text = F.replace(text, F.lit(old), F.lit(new))
        if self.letters:
            text = F.translate(text, "".join(self.letters), "".join(self.letters.values()))
        return F.regexp_replace(text, SPACES, " ")


_cleaners: dict[str, Cleaner] = {}


def register_cleaner(cleaner: Cleaner) -> Cleaner:
    """Make a cleaner known by its name; a name is given once."""
    if cleaner.name in _cleaners:
        raise ValueError(f"a cleaner named {cleaner.name} is registered already")
    _cleaners[cleaner.name] = cleaner
    return cleaner


def cleaner(name: str) -> Cleaner:
    return _cleaners[name]


def cleaner_names() -> list[str]:
    return list(_cleaners)


def _without(letters: dict[str, str], kept: str) -> dict[str, str]:
    return {k: v for k, v in letters.items() if k not in kept}


_PUNCTUATION = dict.fromkeys(ASCII_PUNCTUATION + QUOTES, " ")
_GERMAN = _without(ACCENTS | _PUNCTUATION | DASHES, "äüöß")
register_cleaner(Cleaner("none"))
register_cleaner(Cleaner("none_lower_veryfirst", lower_first=True))
register_cleaner(Cleaner("no_punct", dict.fromkeys(ASCII_PUNCTUATION + "„“’”—…", " ")))
register_cleaner(Cleaner("de", _GERMAN))
register_cleaner(Cleaner("de_no_sz", _GERMAN, DECOMPOSED | {"ß": "ss"}))
register_cleaner(Cleaner("ru", ACCENTS | _PUNCTUATION | CYRILLIC | {"ё": "е", "ë": "е"}, DECOMPOSED | CYRILLIC_GROUPS))
register_cleaner(Cleaner("es", _without(ACCENTS, "ñüöáéíóú") | _PUNCTUATION))
register_cleaner(Cleaner("en", _without(ACCENTS | _PUNCTUATION | dict.fromkeys(APOSTROPHES, "'") | DASHES, "-'")))


def set_casing(text: Column, casing: str) -> Column:
    """``lower``, ``upper`` or ``original``."""
    ways: dict[str, Callable[[Column], Column]] = {"lower": F.lower, "upper": F.upper, "original": lambda x: x}
    return ways[casing](text)


def filter_letters(text: Column, vocabulary: str) -> Column:
    """Only letters of a vocabulary and spaces; spaces at the ends go."""
    letters = "".join("\\" + c if c in "\\]^-[&" else c for c in vocabulary)
    return F.trim(F.regexp_replace(text, f"[^{letters} ]", ""))


def clean_cased(text: Column, name: str, casing: str = "lower") -> Column:
    return set_casing(F.trim(cleaner(name)(text)), casing)


def clean_for_vocabulary(text: Column, name: str, vocabulary: str, casing: str = "lower") -> Column:
    """Clean, case, collapse white space and keep the vocabulary's letters; a second run of spaces may stay."""
    return filter_letters(F.regexp_replace(clean_cased(text, name, casing), SPACES, " "), vocabulary)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def drop_punctuation(text: Column) -> Column:
    """Without ASCII punctuation but for ' and the backslash."""
    return F.translate(text, ASCII_PUNCTUATION.replace("'", "").replace("\\", ""), "")


def drop_listed_characters(text: Column, characters: str) -> Column:
    """Lower-cased without some characters, with a space behind."""
    return F.concat(F.lower(F.translate(text, characters, "")), F.lit(" "))


def words_regex(text: Column, pattern: str = r"(?U)\w+(?:'\w+)?|[^\w\s]") -> Column:
    """Tokens by a pattern: words with an inner apostrophe, and single marks."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def simple_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def prefix_words(text: Column, dropped: int) -> Column:
    """All but the last words, two at least."""
    tokens = simple_tokens(text)
    return F.array_join(F.slice(tokens, 1, F.greatest(F.lit(2), F.size(tokens) - dropped)), " ")


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    whole = ms.cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0L") + F.floor(whole / 3600000), F.floor(whole / 60000) % 60, F.floor(whole / 1000) % 60, whole % 1000)


def majority_upper(text: Column, sample: Column) -> Column:
    """Upper-case if more than half of the sample's characters equal their upper case, else lower-case."""
    chars = F.split(sample, "")
    upper = F.size(F.filter(chars, lambda c: F.upper(c) == c))
    return F.when(upper > F.size(chars) / 2, F.upper(text)).otherwise(F.lower(text))


def stem_of_path(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def move_path(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), path.substr(F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def sox_command(source: Column, target: Column, gain_db: Column, low_hz: Column, high_hz: Column) -> Column:
    """The command line of a gain and a band pass; it is built here, not run."""
    return F.format_string("sox %s %s gain %.2f sinc %.0f-%.0f", source, target, gain_db, low_hz, high_hz)


def sox_part(source: Column, **effects: str | float | tuple) -> Column:
    """A piped command: effects with their values, in order; a source that is a command itself is put in brackets."""
    values = lambda v: " ".join(map(str, v)) if isinstance(v, (tuple, list)) else str(v)
    chain = " ".join(f"{k.replace('_', ' -')} {values(v)}" for k, v in effects.items())
    return F.concat(F.lit("sox "), F.when(source.startswith("sox"), F.concat(F.lit("<("), source, F.lit(")"))).otherwise(source), F.lit(f" -p {chain}"))


def sox_noise(source: Column, slow: float = 0.1, low: int = 7000, high: int = 1, gain: float = -4) -> Column:
    """Band-passed noise whose loudness follows slow noise, as long as the source."""
    return F.concat(F.lit("sox "), source, F.lit(f" -p synth whitenoise lowpass {slow} synth whitenoise amod gain -n {gain} sinc {high}-{low}"))


def sox_factor(source: Column, low: float = 1, gain: float = -9) -> Column:
    """A slowly changing factor: quiet slow noise upon a constant of a half."""
    return F.concat(F.lit("sox -m <(sox "), source, F.lit(f" -p synth whitenoise lowpass {low} gain -n {gain}) <(sox "), source, F.lit(" -p gain -90 dcshift 0.5) -p"))


def sox_product(a: Column, b: Column) -> Column:
    return F.concat(F.lit("sox -T <("), a, F.lit(") <("), b, F.lit(") -p"))


def sox_varying_gain(source: Column, low: float = 1, gain: float = -6) -> Column:
    return sox_product(sox_factor(source, low, gain), F.concat(F.lit("sox "), source, F.lit(" -p ")))


def sox_sum(signals: list[Column], target: Column, as_long_as: Column | None = None) -> Column:
    """Signals added and written in 16 bits; cut to the length of a file if one is named."""
    parts = F.concat_ws(" ", *(F.concat(F.lit("<("), s, F.lit(")")) for s in signals))
    whole = F.concat(F.lit("sox -m "), parts, F.lit(" -b 16 "), target)
    return whole if as_long_as is None else F.concat(whole, F.lit(" trim 0 $(soxi -D "), as_long_as, F.lit(")"))


def sox_transcode(source: Column, target: Column, codec: Column) -> Column:
    """Through an old telephone's codec: ``g711``, or a mode (0 to 7) of ``amr-nb``; others are null."""
    amr = F.concat(F.lit("sox "), source, F.lit(" -V0 -C "), codec, F.lit(" -t amr-nb - | sox -t amr-nb - -V0 -b 16 -r 16000 "), target)
    law = F.concat(F.lit("sox "), source, F.lit(" -V0  -r 8000 -c 1 -e a-law "), target)
    return F.when(codec == "g711", law).when(codec.rlike("^[0-7]$"), amr)


def drop_newlines(c: Column, by: str = "") -> Column:
    """Line feeds and carriage returns replaced."""
    return F.regexp_replace(c, "[\\n\\r]", by)
