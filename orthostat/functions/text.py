"""String parsing of catalogue records as column expressions; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The twenty region identifiers and names.
REGIONS = {
    "01": "Piemonte", "02": "Valle d'Aosta", "03": "Lombardia", "04": "Trentino-Alto Adige", "05": "Veneto",
    "06": "Friuli-Venezia Giulia", "07": "Liguria", "08": "Emilia-Romagna", "09": "Toscana", "10": "Umbria",
    "11": "Marche", "12": "Lazio", "13": "Abruzzo", "14": "Molise", "15": "Campania", "16": "Puglia",
    "17": "Basilicata", "18": "Calabria", "19": "Sicilia", "20": "Sardegna",
}
# Words by which a bracketed text is taken as a period.
PERIOD_WORDS = ["bronzo", "neolitico", "millennio", "eneolitico", "calcolitico", "bc", "a.c."]
# Architectural words, and the words of each functional category, looked for in texts.
ARCHITECTURE_WORDS = [
    "lastra", "lastrone", "lastre", "copertura", "ortostati", "camera", "corridoio", "dromos", "ingresso", "tumulo",
    "cairn", "megalite", "monolite", "menhir", "pietra", "blocco", "allée couverte", "tholos", "cista", "galleria",
    "portale", "slab", "cover", "chamber", "corridor", "entrance", "capstone", "portal", "falsa cupola",
]
FUNCTION_WORDS = {
    "funerary": ["funerario", "funeraria", "sepoltura", "tomba", "funerary", "burial", "tomb", "necropoli"],
    "cultic": ["cultuale", "sacro", "rituale", "cultic", "sacred", "ritual"],
    "domestic": ["abitativo", "insediamento", "domestic", "settlement"],
}


def _present(text: Column) -> Column:
    """Null where a text is blank."""
    return F.when(F.length(F.trim(text)) > 0, F.trim(text))


def site_name(label: Column) -> Column:
    """The name in a catalogue label, without type prefix, place and bracketed parts."""
    bare = F.when(F.lower(label).startswith("dolmen,"), F.trim(F.substring(label, 8, 100_000))).otherwise(label)
    head = F.regexp_extract(bare, r"^([^(]+)", 1)
    name = F.trim(F.split(F.trim(head), " - ", 2)[0])
    return F.when(head != "", name).otherwise(F.trim(F.split(bare, ",", 2)[0]))


def period_in_label(label: Column) -> Column:
    """The period named in the last brackets of a label, or null."""
    raw = F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)
    known = F.lower(raw).rlike("|".join(w.replace(".", r"\.") for w in PERIOD_WORDS))
    deep = F.upper(raw).contains("PERIODIZZAZIONI")
    return F.when(raw == "", None).when(deep, F.trim(F.element_at(F.split(raw, "/"), -1))).when(known, F.trim(raw))


def municipality(coverage: Column) -> Column:
    """The place before brackets, or all of it."""
    first = F.regexp_extract(coverage, r"^([^(]+)\s*\(([^)]+)\)", 1)
    return F.when(coverage == "", None).when(first != "", F.trim(first)).otherwise(F.trim(coverage))


def province(coverage: Column) -> Column:
    """What the brackets hold, or null."""
    inner = F.regexp_extract(coverage, r"^([^(]+)\s*\(([^)]+)\)", 2)
    return F.when(inner != "", F.trim(inner))


def category_of(uri: Column) -> Column:
    """The last segment of a category URI as words."""
    return F.when(uri != "", F.replace(F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1), F.lit("-"), F.lit(" ")))


def context_of(uri: Column) -> Column:
    """The same without the word for context."""
    return F.replace(category_of(uri), F.lit("contesto "), F.lit(""))


def address_region(address: Column) -> Column:
    """The second part of an address, unless it is the country."""
    part = F.trim(F.get(F.split(address, ","), F.lit(1)))
    return F.when(part != "ITALIA", part)


def address_province(address: Column) -> Column:
    """The third part, if it is no longer than a province code."""
    part = F.trim(F.get(F.split(address, ","), F.lit(2)))
    return F.when(F.length(part) <= 3, part)


def region_name(region_id: Column) -> Column:
    """Name of a region identifier; one digit is padded."""
    padded = F.when(F.length(region_id) < 2, F.lpad(region_id, 2, "0")).otherwise(region_id)
    return F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))[padded]


def display_name(name: Column, label: Column) -> Column:
    """The name, or the label before its first comma."""
    return F.coalesce(_present(name), F.trim(F.split(label, ",", 2)[0]))


def reference_of(uri: Column, catalogue: str, data: str) -> Column:
    """Catalogue URIs by their last segment, other URLs as they are, the rest as local names."""
    # fixed values: the marks of the catalogue's own URIs
    own = uri.contains("dati.beniculturali.it") | F.lower(uri).contains("arco")
    last = F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1)
    url = uri.startswith("http://") | uri.startswith("https://")
    return F.when(own, F.concat(F.lit(catalogue), last)).when(url, uri).when(uri != "", F.concat(F.lit(data), uri))


def duration_of(hours: Column) -> Column:
    """Hours as an ISO 8601 duration; minutes are rounded half to even."""
    whole = hours.cast("long")
    minutes = F.bround((hours - whole) * 60).cast("long")
    text = F.concat(F.lit("PT"), F.when(whole > 0, F.concat(whole.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when((whole == 0) & (minutes == 0), F.lit("PT0H")).otherwise(text)


def slug(theme: Column) -> Column:
    """Lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(theme), " -", "__")


def feature_label(label: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Lower case, one blank between words, two canonical forms; ``lemmas`` replaces words (default: none)."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[_-]", " "), r"\s+", " "))
    text = F.when(text == "periurban", "peri urban").when(text == "piedritti", "piedritto").otherwise(text)
    for word, lemma in (lemmas or {}).items():
        text = F.regexp_replace(text, rf"\b{word}\b", lemma)
    return text


def excerpt(text: Column, length: int) -> Column:
    """A text, cut off with an ellipsis when longer than ``length``."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def retry_delay(message: Column) -> Column:
    """Seconds to wait that an error message names, or null."""
    first = r"'retryDelay':\s*'([\d.]+)(s|ms)'"
    value, unit = F.regexp_extract(message, first, 1).try_cast("double"), F.regexp_extract(message, first, 2)
    plain = F.regexp_extract(message, r"Please retry in ([\d.]+)s", 1).try_cast("double")
    return F.when(unit == "ms", value / 1000).when(unit == "s", value).otherwise(plain)


def json_in(text: Column) -> Column:
    """The widest object in a reply, else the widest array, else null."""
    object_, array = F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(object_ != "", object_).when(array != "", array)


def unfenced(reply: Column) -> Column:
    """What a code fence in a reply holds, or the reply."""
    body = F.trim(reply)
    json_ = F.split(F.split(body, "```json")[1], "```")[0]
    plain = F.split(F.split(body, "```")[1], "```")[0]
    return F.when(body.contains("```json"), json_).when(body.contains("```"), plain).otherwise(body)


def cache_key(uris: Column) -> Column:
    """md5 of the sorted distinct URIs, joined."""
    return F.md5(F.array_join(F.array_sort(F.array_distinct(F.array_compact(uris))), ""))


def features_in(text: Column) -> Column:
    """Architectural words in a text and ``cat:<category>`` of the functional ones, in fixed order."""
    low = F.lower(text)
    words = F.filter(F.array(*(F.lit(w) for w in ARCHITECTURE_WORDS)), lambda w: F.contains(low, w))
    kinds = F.array(*(F.when(low.rlike("|".join(ws)), F.lit(f"cat:{kind}")) for kind, ws in FUNCTION_WORDS.items()))
    return F.concat(words, F.array_compact(kinds))
