"""Transliteration to ASCII and accent stripping, driven by Unicode decomposition."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinaria.session import let

# Letters without a decomposition, and what they are written as in ASCII.
SINGLE = {
    "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k",
    "ª": "a", "º": "o",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "ι": "i", "κ": "k",
    "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s",
    "τ": "t", "υ": "u", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "ы": "y", "э": "e",
}
MULTIPLE = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "™": "tm", "©": "(c)", "®": "(r)",
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps",
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia",
}
# Letters of further scripts and their usual romanisation, one spelling per sign, written sign=spelling.
SCRIPTS = {
    "hebrew": "א= ב=b ג=g ד=d ה=h ו=v ז=z ח=kh ט=t י=y ך=k כ=k ל=l ם=m מ=m ן=n נ=n ס=s ע= ף=p פ=p ץ=ts צ=ts ק=q ר=r ש=sh ת=t",
    "arabic": "ا=a ب=b ة=h ت=t ث=th ج=j ح=h خ=kh د=d ذ=dh ر=r ز=z س=s ش=sh ص=s ض=d ط=t ظ=z ع= غ=gh ف=f ق=q ك=k ل=l م=m ن=n ه=h و=w ى=a ي=y",
    "georgian": "ა=a ბ=b გ=g დ=d ე=e ვ=v ზ=z თ=t ი=i კ=k ლ=l მ=m ნ=n ო=o პ=p ჟ=zh რ=r ს=s ტ=t უ=u ფ=p ქ=k ღ=g ყ=q შ=sh ჩ=ch ც=ts ძ=dz წ=ts ჭ=ch ხ=kh ჯ=j ჰ=h",
    "armenian": "ա=a բ=b գ=g դ=d ե=e զ=z է=e ը=e թ=t ժ=zh ի=i լ=l խ=kh ծ=ts կ=k հ=h ձ=dz ղ=gh ճ=ch մ=m յ=y ն=n շ=sh ո=o չ=ch պ=p ջ=j ռ=r ս=s վ=v տ=t ր=r ց=ts ւ=w փ=p ք=k օ=o ֆ=f",
}
# The kana by consonant, vowels in the order a i u e o; a dot is a sound that is not written.
KANA = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど",
    "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や.ゆ.よ", "r": "らりるれろ", "w": "わゐ.ゑを",
}
IRREGULAR_KANA = {"し": "shi", "ち": "chi", "つ": "tsu", "じ": "ji", "ん": "n", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o",
                  "ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
# The letters a Hangul syllable is composed of, in the order of its code point.
INITIALS = ("g", "gg", "n", "d", "dd", "r", "m", "b", "bb", "s", "ss", "", "j", "jj", "c", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "weo", "we", "wi", "yu", "eu", "yi", "i")
FINALS = ("", "g", "gg", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng",
          "j", "c", "k", "t", "p", "h")
SCRIPT_BLOCKS = "[\\u0531-\\u06ff\\u10d0-\\u10ff\\u3041-\\u30ff]"
SYLLABLES = "[\uac00-\ud7a3]"
# Blocks whose characters have an ASCII spelling that is punctuation, kept for later steps.
_PUNCTUATION = "\\x{A0}-\\x{BF}\\x{D7}\\x{F7}\\x{2000}-\\x{206F}\\x{20A0}-\\x{20CF}\\x{2100}-\\x{22FF}\\x{3000}-\\x{3020}"


@lru_cache(maxsize=None)
def _pairs() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every lower-case Latin, Greek, Cyrillic or full-width code point whose
    compatibility decomposition is one letter with an ASCII spelling plus marks."""
    source, target = [], []
    for low, high in [(0xAA, 0x24F), (0x1E00, 0x1EFF), (0xFF01, 0xFF5E), (0x370, 0x4FF)]:
        for code in range(low, high + 1):
            char = chr(code)
            if char != char.lower():
                continue
            base = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
            if len(base) != 1 or base[0] == char:
                continue
            letter = base[0] if ord(base[0]) < 128 else SINGLE.get(base[0])
            if letter:
                source.append(char)
                target.append(letter)
    return "".join(source), "".join(target)


@lru_cache(maxsize=None)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """The ASCII signs in the compatibility decomposition of every other code point: those with one sign (accents, NBSP and other
    spaces, mathematical letters) and those with several (ligatures, the ellipsis, the trade mark)."""
    one, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        char = chr(code)
        signs = "".join(c for c in unicodedata.normalize("NFKD", char) if ord(c) < 128)
        if signs:
            (one if len(signs) == 1 else several)[char] = signs
    return one, several


@lru_cache(maxsize=None)
def _romanised() -> dict[str, str]:
    """The signs of the further scripts and their spellings; katakana stand 0x60 after hiragana."""
    found = {sign: spelling for script in SCRIPTS.values() for sign, _, spelling in (entry.partition("=") for entry in script.split())}
    kana = {sign: consonant + vowel for consonant, row in KANA.items() for sign, vowel in zip(row, "aiueo") if sign != "."} | IRREGULAR_KANA
    return found | kana | {chr(ord(sign) + 0x60): spelling for sign, spelling in kana.items()}


def _spell_scripts(text: Column) -> Column:
    """Signs with several letters: all but the last are put before the sign, one pass for each such beginning, then one ``translate``
    turns every sign into its last letter."""
    spellings = _romanised()
    for beginning in sorted({v[:-1] for v in spellings.values()} - {""}):
        signs = "".join(k for k, v in spellings.items() if v[:-1] == beginning)
        text = F.regexp_replace(text, f"([{signs}])", f"{beginning}$1")
    last = sorted((k for k, v in spellings.items()), key=lambda k: spellings[k] == "")  # translate drops what has no counterpart
    return F.translate(text, "".join(last), "".join(spellings[k][-1:] for k in last))


def _spell_syllables(text: Column) -> Column:
    """Hangul by the arithmetic of its block: 19 initials by 21 vowels by 28 finals."""
    initials, vowels, finals = (F.array(*map(F.lit, letters)) for letters in (INITIALS, VOWELS, FINALS))

    def spell(sign: Column) -> Column:
        n = F.ascii(sign) - 0xAC00
        return F.when(n.between(0, 11171), F.concat(
            F.get(initials, (n / 588).cast("int")), F.get(vowels, (n % 588 / 28).cast("int")), F.get(finals, n % 28))).otherwise(sign)

    return F.array_join(F.transform(F.split(text, ""), spell), "")


def _if_not_ascii(col: Column, body) -> Column:
    """Plain ASCII text, the common case, skips the character-wise work."""
    return let(col, lambda c: F.when(c.rlike("[^\\x00-\\x7F]"), body(c)).otherwise(c))


def _unless_one_byte(word: Column, body) -> Column:
    """``body`` of a bound word unless it is ASCII, which has as many bytes as signs; a pattern would cost more per word than all else."""
    return F.when(F.octet_length(word) == F.char_length(word), word).otherwise(body(word))


def to_ascii(col: Column) -> Column:
    """ASCII spelling of lower-case text: Latin, Greek, Cyrillic, Hebrew, Arabic, Georgian, Armenian, kana and Hangul. Characters of other
    scripts are dropped."""
    source, target = _pairs()
    extra = {k: v for k, v in SINGLE.items() if k not in source}

    def spell_out(out: Column) -> Column:
        for char, spelling in MULTIPLE.items():
            out = F.replace(out, F.lit(char), F.lit(spelling))
        return out

    def rest(out: Column) -> Column:
        out = let(out, lambda o: F.when(o.rlike(f"[{''.join(MULTIPLE)}]"), spell_out(o)).otherwise(o))
        out = let(out, lambda o: F.when(o.rlike(SCRIPT_BLOCKS), _spell_scripts(o)).otherwise(o))
        out = let(out, lambda o: F.when(o.rlike(SYLLABLES), _spell_syllables(o)).otherwise(o))
        return F.regexp_replace(out, f"[^\\x00-\\x7F{_PUNCTUATION}]", "")

    def fold(c: Column) -> Column:
        return let(F.translate(c, source + "".join(extra), target + "".join(extra.values())), lambda o: _unless_one_byte(o, rest))

    # Every step works sign by sign, so words without such signs, most of a text, need none of them.
    return _if_not_ascii(col, lambda text: F.array_join(F.transform(F.split(text, " "), lambda word: _unless_one_byte(word, fold)), " "))


def strip_accents_ascii(col: Column) -> Column:
    """Compatibility decomposition with everything non-ASCII dropped (``ß`` and emoji vanish; NBSP is a space, ``…`` three dots)."""
    one, several = _decompositions()
    # One literal text, parsed once when the plan is made; the signs below cannot occur in it otherwise.
    spelled = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))
    rare, mark = "".join(several), "\ue000"

    def spell_out(text: Column) -> Column:
        # A map is searched key by key, so ASCII signs, nearly all of a text, are not looked up.
        return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c <= "\x7f", c).otherwise(F.coalesce(F.try_element_at(spelled, c), c))), "")

    def fold(text: Column) -> Column:
        # One pass marks the signs that need a spelling; a class of hundreds of signs in a pattern would be tried sign by sign.
        text = let(text, lambda t: F.when(F.contains(F.translate(t, rare, mark * len(rare)), F.lit(mark)), spell_out(t)).otherwise(t))
        return F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), "[^\\x00-\\x7F]", "")

    return _if_not_ascii(col, fold)
