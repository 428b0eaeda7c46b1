"""Defective answers of prompt and response pairs, one text pair at a time."""

from __future__ import annotations

import re

import regex
import zstandard

from segmill.llm.charstats import BROKEN, Commonness

#: Control tokens (fixed values): raw bytes, printf, named and numeric braces, brackets, escapes.
CONTROL = re.compile(r"\{\{[0-9A-Fa-f:]{2,5}\}\}|%(?:\d+\$)?[-+ #0]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[A-Za-z]|\{/?[A-Za-z_0-9][^{}]{0,80}\}|\[[^\[\]]{0,80}\]|\\[nNtr\\]")
#: White space and characters without ink.
EMPTY = re.compile("[\\s\u00ad\u034f\u061c\u115f\u1160\u180b-\u180f\u200b-\u200f\u2028-\u202f\u205f-\u206f\u2800\u3164\ufe00-\ufe0f\ufeff\uffa0]+")

_KANA = re.compile("[ぁ-ゖゝ-ゟァ-ヺー-ヿｦ-ﾝ]")
_CJK = re.compile("[ぁ-ゖゝ-ゟァ-ヺー-ヿｦ-ﾝ㐀-鿿豈-﫿\U00020000-\U0003ffff々〆]")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_HAN = regex.compile(r"\p{Han}")
_SIGNS = regex.compile(r"[^\p{L}\p{N}]+")
_LABEL = re.compile(r"^\s*(?:>+|[^\s:：]{1,8}[:：])\s*")
_BRACKETED_END = re.compile(r"[（(][^（()）]{0,40}[)）]\s*$")

#: Refusals (fixed values): a decline or an apology, and what it speaks about, in the same text. Dialogue that
#: refuses speaks about neither the text nor the translation.
_DECLINES = re.compile(
    r"抱歉|对不起|恕我|恕难|无法|不能|没法|不便|未能|拒绝|不符合|违反|不支持|請原諒|"
    r"(?i:sorry|apologi[sz]e|cannot|can[’']t|can not|unable|won[’']t|not able|not allowed|refuse|decline|against the)|"
    r"申し訳|すみません|ごめんなさい|できません|できかねます|お答えできない|致しかねます"
)
_ABOUT = re.compile(
    r"翻译|译出|译文|翻譯|请求|文本|内容|语言模型|人工智能助手|规范|政策|上下文|敏感|提供更多|"
    r"(?i:translat|request|language model|AI assistant|as an AI|guideline|policy|policies|content|the passage|this text|help with that|assist)|"
    r"翻訳|リクエスト|ポリシー|ガイドライン|言語モデル|この文章|コンテンツ"
)


#: Frequent function words of languages other than Chinese (fixed values).
_LANGUAGES = {
    "en": "the a of to and in is was it for on with that this we you they did do not he she him her before after nobody",
    "fr": "le la les un une des du de et est était dans pour que qui nous vous ne pas avant depuis personne",
    "de": "der die das ein eine und ist war nicht mit für auf von zu wir sie er ich vor nach",
    "es": "el la los las un una de y es era en para que no con nosotros ellos antes desde nadie",
    "ru": "и в не на я он она мы они что это у же с по где никто был была минут",
    "vi": "không ai biết là của và có trong ở đã chúng tôi này số cho một người",
    "ko": "그 이 저 에 의 를 을 은 는 안에 대해 않았다 있었다 아무도 앞에서",
}
_WORD_LANGUAGES: dict[str, list[str]] = {}
for _language, _words in _LANGUAGES.items():
    for _word in _words.split():
        _WORD_LANGUAGES.setdefault(_word, []).append(_language)


def language_of(text: str) -> tuple[str | None, int]:
    """``(language, different words of it)``: the one whose dictionary holds most words of the text; None for none."""
    hits: dict[str, int] = {}
    for word in {w.lower() for w in _WORDS.findall(CONTROL.sub(" ", text))}:
        for language in _WORD_LANGUAGES.get(word, ()):
            hits[language] = hits.get(language, 0) + 1
    best = max(hits, key=lambda k: (hits[k], k), default=None)
    return best, hits.get(best, 0)


def bare(text: str) -> str:
    """The text without control tokens, white space and characters without ink."""
    return EMPTY.sub("", CONTROL.sub("", text))


def is_refusal(target: str) -> bool:
    return _DECLINES.search(target) is not None and _ABOUT.search(target) is not None


def letters_only(text: str) -> str:
    return _SIGNS.sub("", bare(text))


#: Bytes that a message has at least when its cost is measured, so that a short text isn't lost in the frame's own bytes.
MEASURED = 64
#: Greatest cost of a copy, as a share of the answer's bytes: a few words put in, left out or exchanged.
COPIED = 0.4


def copy_ratio(source: str, target: str) -> float:
    """What the target costs beyond the source itself with the source as zstandard dictionary, over its bytes.

    Both are written as often as makes the dictionary and the message long enough to be compressed at all
    (repetitions cost next to nothing), and the source's own cost under its dictionary, that of an exact copy,
    is taken off. Thus an exact copy has 0 and an unrelated text about 1, however short they are.
    """
    raw, prompt = target.encode("utf-8", "surrogatepass"), source.encode("utf-8", "surrogatepass")
    if not raw or not prompt:
        return 1.0
    times = max(1, -(-MEASURED // min(len(raw), len(prompt))))
    held = zstandard.ZstdCompressionDict(prompt * times, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(dict_data=held, compression_params=_COMPRESSION)
    return max(0, len(compressor.compress(raw * times)) - len(compressor.compress(prompt * times))) / len(raw)


_COMPRESSION = zstandard.ZstdCompressionParameters.from_level(1, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def is_copy(source: str, target: str) -> bool:
    """Whether the target gives the source back, perhaps spaced, punctuated or labelled otherwise, or with small edits."""
    a = letters_only(source)
    return bool(a) and any(copy_ratio(a, b) <= COPIED for b in dict.fromkeys((letters_only(target), letters_only(_LABEL.sub("", target)))))


#: Share of foreign letters from which two different words of a language's dictionary make the answer one in that language.
FOREIGN_WORDS = 0.3


def foreign_share(target: str, source: str) -> float:
    """Share of the letters that stand in plain words of other scripts than Han, words of the source apart."""
    own = bare(target)
    known = set(_WORDS.findall(source)) if source else set()
    foreign = han = other = 0
    for word in _WORDS.findall(CONTROL.sub(" ", target)):
        h = len(_HAN.findall(word))
        han += h
        rest = len(word) - h
        if not rest or word in known:
            continue
        plain = h == 0 and (word.islower() or word.istitle() or word.isupper() or word.lower() == word.upper() or word[:1].isupper() and word[1:].islower())
        if plain:
            foreign += rest
        else:
            other += rest
    visible = max(1, len(own))
    total = foreign + han + other
    return foreign / total if total and (foreign + han) / visible > 0.55 else 0.0


def looks_garbled(target: str, common: Commonness) -> bool:
    """Whether unusual characters make up the text without forming plain words."""
    if target.isascii():
        return False
    if len(BROKEN.findall(target.rstrip("\ufffd \n"))) >= 2:
        return True
    if not common.mostly_rare(target):
        return False
    words = [w for w in _WORDS.findall(target) if not _HAN.search(w)]
    plain = sum(len(w) for w in words if len(w) > 1 and (w.islower() or w.istitle() or w.lower() == w.upper()) and not _KANA.search(w))
    return plain < 0.6 * len(bare(target))


def defect(source: str | None, target: str | None, common: Commonness) -> str | None:
    """``empty``, ``refusal``, ``copied``, ``other_language``, ``garbled`` or None, the first that applies.

    A missing source makes no answer a copy. Answers equal to a source without kana and ideographs are
    sound; so are, for this function, copies without kana (see :func:`pairs.defective`).
    """
    if target is None or not bare(target):
        return "empty"
    if is_refusal(target):
        return "refusal"
    source = source or ""
    if looks_garbled(target, common):
        return "garbled"
    kana = len(_KANA.findall(target))
    same = letters_only(source) == letters_only(target) or bare(source) == bare(target)
    if same and not _CJK.search(source):
        return None
    # what gives Japanese back holds kana, unless the source has none
    if kana and is_copy(source, target):
        return "copied"
    if kana:
        return "other_language" if kana >= 3 and kana >= 0.2 * len(letters_only(target)) else None
    if same or len(letters_only(_BRACKETED_END.sub("", target))) < 5:
        return None
    share = foreign_share(target, source)
    return "other_language" if share > 0.5 or (share > FOREIGN_WORDS and language_of(target)[1] >= 2) else None
