"""Text, date and scoring columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Lower-case Latin letters that decompose into a plain letter and marks.
_FOLDED = {
    chr(i): base
    for i in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))
    if chr(i).islower() and len(full := unicodedata.normalize("NFD", chr(i))) > 1 and "a" <= (base := full[0]) <= "z"
}
_ACCENTED, _PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())

# Words that never become a keyword.
STOPWORDS = tuple(dict.fromkeys((
    # Spanish
    "las", "los", "una", "unas", "unos", "del", "con", "por", "para", "que", "qué", "como", "cómo", "más", "mas", "sus",
    "este", "esta", "estos", "estas", "ese", "esa", "esos", "esas", "aquí", "allí", "ser", "son", "está", "están", "estás",
    "hay", "fue", "muy", "sin", "sobre", "también", "tambien", "hasta", "desde", "entre", "cuando", "donde", "dónde",
    "quien", "quién", "nos", "les", "nuestro", "nuestra", "nuestros", "nuestras", "tus", "mis", "sí", "no", "pero",
    "porque", "todo", "toda", "todos", "todas", "otro", "otra", "otros", "otras", "ver", "puede", "pueden", "hacer",
    "tiene", "tienen", "años", "año", "día", "días",
    # English
    "the", "and", "for", "with", "that", "this", "you", "your", "are", "was", "have", "has", "not", "but", "all", "can",
    "our", "from", "how", "what", "when", "where", "why", "who", "will", "more", "one", "two", "new", "get", "use", "about",
    "into", "out", "them", "their", "they", "its",
    # page furniture
    "inicio", "home", "menú", "menu", "buscar", "cuenta", "carrito", "login", "cookies", "aceptar", "política",
    "privacidad", "términos", "condiciones", "contacto", "copyright", "reservados", "derechos", "página", "web", "sitio",
    "online", "click", "clic", "leer", "email", "newsletter",
)))

# Field weights.
TITLE_WEIGHT, H1_WEIGHT, DESCRIPTION_WEIGHT, BODY_WEIGHT = 4, 3, 2, 1
TOP_KEYWORDS = 5

WORD = "[a-záéíóúüñàèìòù0-9]{3,}"


def fold(text: Column) -> Column:
    """Lower case without diacritics: precomposed Latin letters are mapped, combining marks dropped."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[\x{0300}-\x{036f}]", "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_IN_STOPWORDS = "IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
# SQL predicate of a word ``w`` that may become a keyword.
IS_CONTENT_WORD = (
    f"NOT w {_IN_STOPWORDS} AND NOT translate(w, '{_ACCENTED}', '{_PLAIN}') {_IN_STOPWORDS} AND NOT w RLIKE '^[0-9]+$'"
)


def boundary_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))


def mention_offset(folded_text: Column, folded_term: Column) -> Column:
    """1-based offset of the first whole-word occurrence, 0 when absent."""
    return F.when(folded_text.contains(folded_term), F.regexp_instr(folded_text, boundary_pattern(folded_term))).otherwise(
        F.lit(0)
    )


# Tone labels, in the order they are looked for.
FRAMINGS = ["positivo", "neutro", "negativo", "con_reservas"]


def framing_label(reply: Column) -> Column:
    folded = fold(reply)
    label = F.when(folded.contains(FRAMINGS[0]), F.lit(FRAMINGS[0]))
    for name in FRAMINGS[1:]:
        label = label.when(folded.contains(name), F.lit(name))
    return label.otherwise(F.lit("neutro"))


# What makes a headline relevant.
RELEVANT_TERMS = [
    "posicionamiento web", "algoritmo de google", "ia generativa", "busqueda con ia", "chatgpt", "google search",
    "motor de busqueda", "motores de busqueda", "inteligencia artificial", "buscador de google",
]
RELEVANT_ACRONYMS = ["SEO", "LLM"]


def is_relevant(headline: Column) -> Column:
    terms = "|".join(RELEVANT_TERMS)
    acronyms = "|".join(RELEVANT_ACRONYMS)
    # acronyms first: folding is the costly part
    return headline.rlike(rf"(?U)\b({acronyms})\b") | fold(headline).rlike(rf"(?<![a-z0-9])({terms})(?![a-z0-9])")


def relative_time(age_seconds: Column) -> Column:
    """Feed caption of an age; a date in the future reads as just now."""
    minutes = F.greatest(F.floor(age_seconds / 60), F.lit(1)).cast("string")
    hours = F.floor(age_seconds / 3600)
    days = F.floor(age_seconds / 86400)
    return (
        F.when(age_seconds.isNull(), F.lit(""))
        .when(age_seconds < 0, F.lit("hace un momento"))
        .when(age_seconds < 3600, F.concat(F.lit("hace "), minutes, F.lit(" min")))
        .when(age_seconds < 86400, F.when(hours > 1, F.concat(F.lit("hace "), hours.cast("string"), F.lit(" horas"))).otherwise(F.lit("hace 1 hora")))
        .otherwise(F.when(days > 1, F.concat(F.lit("hace "), days.cast("string"), F.lit(" días"))).otherwise(F.lit("hace 1 día")))
    )


def short_age(age_seconds: Column) -> Column:
    return (
        F.when(age_seconds < 3600, F.concat(F.lit("hace "), F.greatest(F.floor(age_seconds / 60), F.lit(1)).cast("string"), F.lit(" min")))
        .when(age_seconds < 86400, F.concat(F.lit("hace "), F.floor(age_seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.lit("hace "), F.floor(age_seconds / 86400).cast("string"), F.lit(" d")))
    )


def rfc822_timestamp(text: Column) -> Column:
    """Publication date of a feed item; NULL when it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))


# Message fragments of a name-resolution failure, and one label per failure class.
DNS_MARKERS = [
    "getaddrinfo failed", "name or service not known", "name resolution", "nodename nor servname",
    "no address associated", "name does not resolve", "temporary failure in name resolution",
    "name_not_resolved", "err_name_not_resolved", "nxdomain",
]
ERROR_LABELS = {
    "dns_not_found": "El dominio no existe o no resuelve (DNS)",
    "timeout": "El servidor no respondió a tiempo",
    "connection_refused": "El servidor rechazó la conexión",
    "ssl_error": "Falló la conexión segura (certificado/TLS)",
    "connection_error": "No se pudo conectar con el servidor",
}


def fetch_error_class(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.rlike("|".join(DNS_MARKERS)), F.lit("dns_not_found"))
        .when(m.rlike("timed out|timeout"), F.lit("timeout"))
        .when(m.contains("refused"), F.lit("connection_refused"))
        .when(m.rlike("ssl|certificate|err_cert|tls"), F.lit("ssl_error"))
        .otherwise(F.lit("connection_error"))
    )


def error_label(code: Column) -> Column:
    label = None
    for name, text in ERROR_LABELS.items():
        label = F.when(code == name, F.lit(text)) if label is None else label.when(code == name, F.lit(text))
    return label.otherwise(F.lit(ERROR_LABELS["connection_error"]))


# The retry delay and its ceiling, in seconds.
BACKOFF_BASE, BACKOFF_MAX = 1.5, 20.0


def retry_delay(retry_after: Column, attempt: Column) -> Column:
    """The delay the server asked for, floored at zero, else capped exponential backoff."""
    asked = retry_after.try_cast("double")
    return F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0))).otherwise(
        F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), attempt), F.lit(BACKOFF_MAX))
    )


def certificate_expiry(not_after: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(not_after, " +", " "), F.lit("MMM d HH:mm:ss yyyy z"))


def days_until(expiry: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(expiry) - F.unix_timestamp(as_of)
    return F.floor(seconds / 86400).cast("long")


def score_band(score: Column) -> Column:
    return F.when(score < 50, F.lit("critical")).when(score < 80, F.lit("warning")).otherwise(F.lit("good"))


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 0.5, F.lit("good")).when(rate > 0, F.lit("warning")).otherwise(F.lit("critical"))


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals; empty when NULL."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", value))
