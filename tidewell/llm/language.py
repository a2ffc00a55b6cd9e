"""The language of short texts, by script and function words."""

from __future__ import annotations

import re

#: Frequent function words of each language that is written with Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with be by this from or an which have has had not but they were when before after if so its no at than these there where while each into once does do how what why can you please i my",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn hoch davon falls warum welche bevor keine kein ohne ich daher während",
    "fr": "le la les de des du et en un une est que pour dans qui par sur pas plus au avec ce il elle ne se sont aux ou son sa ses cette mais comme on leur être avant après lors sans ainsi tandis puis donc même chaque vers je vous entre quelles quelle pourquoi comment moins était où",
    "es": "el la los las de del y en un una es que para por con no se su al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante antes después cada mientras fue era qué cuál cómo así según aunque puede yo unas tiene",
    "pt": "o a os as de do da dos das e em um uma é que para por com não se na no ao mais como mas foi ele sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas esse eles antes cada enquanto são",
}
_WORDS: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _WORDS.setdefault(_w, []).append(_language)

_KANA, _HAN, _CYRILLIC = re.compile("[぀-ヿ]"), re.compile("[一-鿿㐀-䶿]"), re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[a-zà-öø-ÿœ]+(?:['’](?=[a-zà-ÿ]))?")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`|\S*_\S*|[“\"][^”\"]{1,40}[”\"]", re.S)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")


def language_of(text: str) -> str | None:
    """The language of one sentence; None if it has too few words to tell."""
    text = _CODE.sub(" ", text.lower())
    han, kana, cyrillic = len(_HAN.findall(text)), len(_KANA.findall(text)), len(_CYRILLIC.findall(text))
    words = _LATIN.findall(text)
    latin = sum(map(len, words))
    if kana >= 2 and kana + han > latin / 3:
        return "ja"
    if han >= 3 and han > latin / 4:
        return "zh"
    if cyrillic >= 4 and cyrillic > latin:
        return "ru"
    score: dict[str, float] = {}
    for w in words:
        known = _WORDS.get(w.rstrip("'’"))
        if known:
            for language in known:
                score[language] = score.get(language, 0) + 1 / len(known)
    if not score:
        return None
    ranked = sorted(score.items(), key=lambda x: -x[1])
    best, most = ranked[0]
    second = ranked[1][1] if len(ranked) > 1 else 0
    return best if most >= 1 and most > 1.25 * second else None


def languages_of(text: str) -> dict[str, int]:
    """Characters of the text's sentences by language; sentences without a clear one are left out."""
    found: dict[str, int] = {}
    for s in _SENTENCE.split(_CODE.sub(" ", text)):
        if s and (language := language_of(s)):
            found[language] = found.get(language, 0) + len(s)
    return found
