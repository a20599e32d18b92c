"""Text predicates, clean-up and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip

# Noise pattern, clean-up patterns and routing words.
URL_OR_MENTION = r"(?i)(?:https?://\S+|www\.\S+|@\w+)"
TWEET_NOISE = r"(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/\S+)"
NEWS_NOISE = r"[^a-z0-9\\s]"
URGENT_WORDS = ("kill", "murder", "suicide", "bomb", "rape", "pedo", "weapon", "shoot")
HIGH_RISK_WORDS = ("hate", "racist", "slur", "abuse", "threat", "assault", "violent")
LONG_CONTEXT = 260


def words(col: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def is_clean(col: Column, *, min_len: int = 15, max_noise: float = 0.5) -> Column:
    """Long enough, and at most ``max_noise`` URL or mention hits per token."""
    text = strip(col)
    hits = F.size(F.regexp_extract_all(text, F.lit(URL_OR_MENTION), F.lit(0)))
    tokens = F.size(words(text))
    return (F.length(text) >= min_len) & (tokens > 0) & (hits / tokens <= max_noise)


def clean_text(col: Column, style: str = "tweet") -> Column:
    """Lower-case and blank out mentions, punctuation and links."""
    pattern = {"tweet": TWEET_NOISE, "news": NEWS_NOISE}[style]
    return F.regexp_replace(F.lower(col), pattern, " ")


def not_blank(col: Column) -> Column:
    """P24."""
    return F.length(strip(F.coalesce(col, F.lit("")))) > 0


def route_expert(col: Column, n_experts: int) -> Column:
    """0 by default, 1 for long or high-risk text, 2 for urgent text, clipped to the list."""
    low = F.lower(col)

    def has_any(names: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in names]), lambda w: F.contains(low, w))

    last = n_experts - 1
    return (
        F.when(has_any(URGENT_WORDS), F.lit(min(2, last)))
        .when((F.length(col) > LONG_CONTEXT) | has_any(HIGH_RISK_WORDS), F.lit(min(1, last)))
        .otherwise(F.lit(0))
    )


def corrupt_words(text: Column, key: Column, mode: str, *, keep_least: int = 2) -> Column:
    """Deterministic word-level noise driven by ``md5(key|position)``.

    ``word_dropout`` drops about a quarter of the words and keeps at least ``keep_least``,
    ``word_shuffle`` reorders, ``truncate`` cuts the tail, ``swap_adjacent`` swaps
    half of the neighbouring pairs.  Texts of at most three words lose the last one.
    """
    # as a lambda variable the words are split once a text; as an expression they would be once for every word
    return F.transform(F.array(words(text)), lambda tokens: _corrupted(text, tokens, key, mode, keep_least))[0]


def _corrupted(text: Column, tokens: Column, key: Column, mode: str, keep_least: int) -> Column:
    n = F.size(tokens)

    def draw(i: Column) -> Column:
        hexed = F.substring(F.md5(F.concat_ws("|", key, i.cast("string"))), 1, 8)
        return F.conv(hexed, 16, 10).cast("bigint")

    tagged = F.transform(
        tokens, lambda w, i: F.struct(draw(i).alias("h"), i.alias("i"), w.alias("w"))
    )
    if mode == "word_dropout":
        def dropped(all_: Column) -> Column:
            kept = F.filter(all_, lambda s: s["h"] % 100 >= 25)
            forced = F.array_sort(F.slice(F.array_sort(all_), 1, keep_least), lambda a, b: a["i"] - b["i"])
            return F.transform(F.when(F.size(kept) >= keep_least, kept).otherwise(forced), lambda s: s["w"])

        noisy = F.transform(F.array(tagged), dropped)[0]
    elif mode == "word_shuffle":
        noisy = F.transform(F.array_sort(tagged), lambda s: s["w"])
    elif mode == "truncate":
        low = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
        span = F.greatest(F.lit(1), n - low)
        noisy = F.slice(tokens, F.lit(1), (low + draw(F.lit(-1)) % span).cast("int"))
    elif mode == "swap_adjacent":
        noisy = F.transform(
            tokens,
            lambda w, i: F.coalesce(
                F.when(
                    draw(F.floor(i / 2)) % 2 == 0,
                    F.try_element_at(
                        tokens, F.when(i % 2 == 0, i + 2).otherwise(i).cast("int")
                    ),
                ),
                w,
            ),
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    short = F.slice(tokens, F.lit(1), F.greatest(F.lit(1), n - 1))
    return (
        F.when(n == 0, text)
        .when(n <= 3, F.array_join(short, " "))
        .otherwise(F.array_join(noisy, " "))
    )
