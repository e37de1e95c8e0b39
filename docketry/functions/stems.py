"""Word stems as Columns: the public Snowball rules for English and Russian, as steps on the word's end."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning of their own that a full-text match leaves out.
STOP_WORDS = {
    "english": (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
        "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
        "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split(),
    "russian": (
        "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам "
        "сказал ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь будет ж тогда кто этот говорил того потому этого какой совсем ним "
        "здесь этом один почти мой тем чтобы нее кажется сейчас были куда зачем сказать всех никогда сегодня можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве сказала три "
        "эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между"
    ).split(),
    "simple": [],
}
# Fixed values of the English rules: endings and what takes their place, by step; forms that no rule covers.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
ODD_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIRM_WORDS = "sky news howe atlas cosmos bias andes inning innings outing outings canning cannings herring herrings earring earrings proceed exceed succeed".split()
# Endings of which a word has one if any step changes it, without those that end in another of them.
_CHANGED = {"s", "ed", "ing", "y", "e", "ll", *STEP_2, *STEP_3, *STEP_4}
CHANGED = sorted(a for a in _CHANGED if not any(a != b and a.endswith(b) for b in _CHANGED))
# Fixed values of the Russian rules: endings of each kind.
GERUND = "(?:(?<=[ая])(?:вшись|вши|в)|ившись|ывшись|ивши|ывши|ив|ыв)$"
REFLEXIVE = "(?:ся|сь)$"
ADJECTIVE = "(?:ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$"
PARTICIPLE = "(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$"
VERB = "(?:(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю)$"
NOUN = "(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has, or an empty text."""
    longest = max(map(len, endings))
    return F.regexp_extract(F.substring(word, -longest, longest), f"^.*?({'|'.join(endings)})$", 1)


def _less(word: Column, n: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _region(word: Column, pattern: str) -> Column:
    """How many signs come before the region that begins after ``pattern``; all where it never does."""
    found = F.regexp_extract(word, f"^({pattern})", 1)
    return F.when(found == "", F.length(word)).otherwise(F.length(found))


def english(word: Column) -> Column:
    """The stem of a lower-case word; two letters and less stay."""
    begin, later = "gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy]", "[^aeiouy]*[aeiouy]+[^aeiouy]"
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    regions = lambda w: F.struct(w.alias("w"), _region(w, begin).alias("one"), _region(w, f"(?:{begin}){later}").alias("two"))

    def plural(w: Column) -> Column:
        return let(_ending(w, ("sses", "ied", "ies", "us", "ss", "s")), lambda e: F.when(e == "sses", _less(w, 2)).when(e.isin("ied", "ies"), F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1)))
                   .when((e == "s") & w.rlike("[aeiouy].+s$"), _less(w, 1)).otherwise(w))

    def past(w: Column, one: Column) -> Column:
        def mended(stem: Column) -> Column:
            short = (F.length(stem) <= one) & stem.rlike("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
            return F.when(stem.rlike("(?:at|bl|iz)$") | short, F.concat(stem, F.lit("e"))).when(stem.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(stem, 1)).otherwise(stem)

        def cut(e: Column) -> Column:
            stem = _less(w, F.length(e))
            return F.when(e.isin("eed", "eedly"), F.when(F.length(stem) >= one, F.concat(stem, F.lit("ee"))).otherwise(w)).when((e != "") & stem.rlike("[aeiouy]"), let(stem, mended)).otherwise(w)

        return let(_ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed")), cut)

    def replaced(w: Column, one: Column, two: Column, table: dict[str, str]) -> Column:
        def cut(e: Column) -> Column:
            stem = _less(w, F.length(e))
            fits = (F.length(stem) >= F.when(e == "ative", two).otherwise(one)) & ((e != "ogi") | stem.endswith("l")) & ((e != "li") | stem.rlike("[cdeghkmnrt]$"))
            new = F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), e)
            return F.when((e != "") & fits, F.concat(stem, new)).otherwise(w)

        return let(_ending(w, table), cut)

    def derived(w: Column, two: Column) -> Column:
        def cut(e: Column) -> Column:
            stem = _less(w, F.length(e))
            return F.when((e != "") & (F.length(stem) >= two) & ((e != "ion") | stem.rlike("[st]$")), stem).otherwise(w)

        return let(_ending(w, STEP_4), cut)

    def last(w: Column, one: Column, two: Column) -> Column:
        short = _less(w, 1).rlike("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
        gone = w.endswith("e") & ((F.length(w) > two) | (F.length(w) > one) & ~short) | w.endswith("ll") & (F.length(w) > two)
        return F.when(gone, _less(w, 1)).otherwise(w)

    def steps(r: Column) -> Column:
        one, two = r["one"], r["two"]
        y = lambda w: F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)
        found = r["w"]
        for step in (plural, lambda w: past(w, one), y, lambda w: replaced(w, one, two, STEP_2), lambda w: replaced(w, one, two, STEP_3), lambda w: derived(w, two), lambda w: last(w, one, two)):
            found = let(found, step)
        return F.translate(found, "Y", "y")

    odd = F.create_map(*(F.lit(x) for pair in (*ODD_FORMS.items(), *((w, w.removesuffix("s") if w.endswith("ings") else w) for w in FIRM_WORDS)) for x in pair))
    same = (F.length(word) <= 2) | ~reduce(lambda a, b: a | b, (word.endswith(e) for e in CHANGED))
    return F.when(same, word).otherwise(F.coalesce(F.try_element_at(odd, word), let(let(marked, regions), steps)))


def russian(word: Column) -> Column:
    """The stem of a lower-case word in Cyrillic letters; ё counts as е."""
    plain = F.translate(word, "ё", "е")
    head = F.regexp_extract(plain, "^(.*?[аеиоуыэюя])", 1)

    def endings(rest: Column) -> Column:
        def others(r: Column) -> Column:
            adjective = F.regexp_replace(F.regexp_replace(r, ADJECTIVE, ""), PARTICIPLE, "")
            return F.when(r.rlike(ADJECTIVE), adjective).when(r.rlike(VERB), F.regexp_replace(r, VERB, "")).otherwise(F.regexp_replace(r, NOUN, ""))

        cut = F.when(rest.rlike(GERUND), F.regexp_replace(rest, GERUND, "")).otherwise(let(F.regexp_replace(rest, REFLEXIVE, ""), others))
        return F.regexp_replace(cut, "и$", "")

    vowel, other = "[аеиоуыэюя]", "[^аеиоуыэюя]"
    derived = lambda w: F.regexp_replace(w, f"^({other}*{vowel}+{other}+{vowel}+{other}.*?)ость?$", "$1")
    tidy = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "(?:ейше|ейш)$", ""), "нн$", "н"), "ь$", "")
    return F.when(head == "", plain).otherwise(let(F.concat(head, let(F.substring(plain, F.length(head) + 1, F.length(plain)), endings)), lambda w: tidy(derived(w))))


def _by_rules(word: Column, config: str) -> Column:
    if config == "simple":
        return word
    if config == "english":
        return F.when(~word.isin(STOP_WORDS["english"]), english(word))
    if config == "russian":
        stop = word.isin(STOP_WORDS["english"] + STOP_WORDS["russian"])
        return F.when(~stop, F.when(word.rlike("^[a-z0-9]+$"), english(word)).otherwise(russian(word)))
    raise ValueError(f"no rules for {config}")


def listed(word: Column, by_rules: Column, forms: dict[str, str]) -> Column:
    """``by_rules``, but by ``forms`` (see ``stem``) for the stems that are listed there; it is used more than once."""
    found = F.when(by_rules.isin(*forms), F.concat(F.lit("="), word)).otherwise(by_rules)
    for form, pattern in forms.items():
        found = F.when(word.rlike(f"^(?:{pattern})$"), F.lit(form)).otherwise(found)
    return F.when(by_rules.isNotNull(), found)


def stem(word: Column, config: str, forms: dict[str, str] | None = None) -> Column:
    """The stem of a lower-case word, null for a stop word: ``simple`` keeps all, ``english``, ``russian`` (words in Latin letters go by the English rules).

    ``forms``: for some stems the pattern of all words that are their forms. Another word that the rules give
    such a stem is no form of it: it stays whole, with = before it, so that no stem is like it.
    """
    by_rules = _by_rules(word, config)
    return let(by_rules, lambda s: listed(word, s, forms)) if forms else by_rules
