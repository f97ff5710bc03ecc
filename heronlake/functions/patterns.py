"""Patterns of the release classifier, as data in RE2 syntax, and their translation for Java."""

from __future__ import annotations

import re

# What results must equal.
SEASON_PACK = r"(?i)\bS(?:eason)?[\s._-]?\d{1,2}\b"
EPISODE_CUT = r"(?i)\b(?:S\d{1,2}E\d{1,2}(?:[E-]\d{1,2})*|\d{1,2}x\d{2,}|EP\d{2,4})\b"
EPISODE = r"(?i)\b(?:S(\d{1,2})E(\d{1,2})(?:[E-]\d{1,2})*|(\d{1,2})x(\d{2,})|Ep\.?(\d{1,2})|S(\d{1,2})\s+[-–]\s+(\d{1,4})|EP(\d{2,4}))\b"
SEASON = r"(?i)\bS(?:eason)?[\s._-]?(\d{1,2})\b"
YEAR = r"\b(19\d{2}|20[0-3]\d)\b"
RESOLUTION = r"(?i)\b(2160p|4K(?:\s*UHD)?|1080[pi]|720p|576p|480p|360p)\b"
ENCODING = r"(?i)\b(x265|x264|HEVC|AV1|AVC|XviD|DivX|H\.?265|H\.?264)\b"
DYNAMIC_RANGE = r"(?i)\b(HDR10\+|HDR10|Dolby[\. ]?Vision|DV|HDR|SDR)\b"
SOURCE = r"(?i)\b(BDRemux|BDREMUX|REMUX|BDRip|BluRay|Blu-Ray|WEB-DL|WEBDL|WEBRip|HDTV|DVDRip|DVD|PDVD|HDCAM|PDTV|WEB)\b"
RELEASE_GROUP = r"-([A-Za-z0-9]{2,15})$"
CODEC_TOKEN = r"(?i)\b(x265|x264|HEVC|AV1|AVC|XviD|DivX|H[\. ]?265|H[\. ]?264)\b"
SITE_PREFIX = r"(?i)^www\s+\S+\s+\S+\s*-\s+"
BRACKET_SITE = r"(?i)^\[[\s\w.-]{1,60}\.[a-z]{2,4}\s*\]\s*"
BRACKET_PREFIX = r"^\[.+?\]\s*"
STREAMING = r"(?i)\b(?:Crunchyroll|Funimation|HiDive|HIDIVE)\b"
ABSOLUTE_EPISODE = r"\s+(?:\d{3,4}(?:\s*[-–]\s*\d{1,4})?|-\s+\d{1,4})\b"
EP_NUMBER = r"\bEP\d{2,4}\b"
BARE_EPISODE = r"\s+(?:\d{3}(?:\s*[-–]\s*\d{1,3})?|-\s+\d{1,3})\b"
BRACKET_EPISODE = r"\[\d{1,3}\]"
VIDEO_EXTENSIONS = ".mkv .mp4 .avi .mov .wmv .m4v .ts .m2ts .vob .flv .webm .iso .mpg .mpeg".split()
FANSUB_GROUPS = (
    r"SubsPlease|SubsPlus\+?|Erai-raws|HorribleSubs|ASW|Yameii|DKB|Judas|Commie|MahjongSoulless|ANi|SweetSub|NanakoRaws|AsukaRaws|neoHEVC|Sakurato|Cyan|BBF|jibaketa|Some-Stuffs|Kamigami|"
    r"Studio\s+GreenTea|TRC|Sokudo|Trix|Anime\s+Land|MagicStar|Nekomoe\s+kissaten|GJM|Chihiro|Coalgirls|FFF|WhyNot|Underwater|Ohys-Raws|SmallSizedAnime|SSA|DeadFish|Eclipse|Hiryuu|Hatsuyuki|Vivid"
)
ADULT_WORDS = (
    r"\banal\b|\bass\b|\bblowjobs?\b|\bboob\w*|\bbitch\w*|\bcocks?\b|\bcum\w*\b|deepthroat|\bdicks?\b|\berotic\w*|fuck|gloryhole|\bhardcore\b|\bhorny\b|\bincest\b|\bkink\w*|\bmilf\w*|\bnaughty\b|\bnubile\w*|nude\w*|"
    r"\bonlyfans\b|onahole|\borgasm\w*|\borgy\b|porn|\bpov\b|\bpussy\b|\bseduc\w*|\bslut\w*|step\s*bro(?:ther)?\b|step\s*mom|step\s*sis|step\s*sibling\w*|\btits?\b|\bthreesome\b|\buncensor\w*|wank|xxx|"
    r"\brealitykings\b|\bbrazzers|\bnaughtyamerica\b|\bbangbros\b|\bdigitalpayground\b|\bevil\s*angel\b|\bkink\.com\b|\bnubilefilms\b|\bprivate\.com\b|\bprivatemovies\b|\bwicked\s*pictures\b|woodmancasting\w*|"
    r"\bvividceleb\b|\bmindgeek\b|\bmanwin\b|\bpornhub\b|\bredtube\b|\byouporn\b|\bxvideos\b|\bxhamster\b|\bxnxx\b|\bcastingcouch\w*|\bamateurallure\b|\bblacked\b|\bexploitedteens\b|\bfaceabuse\b|\bfacialabuse\b|"
    r"\bfakeagent\b|\bfemalefaketaxi\b|\bmanyvids\b|\bmomlover\b|momsbangteens|\bpixy\b|\bpuremature\b|\bsinfulxxx\b|teenslikeitbig|\bjav\b|\bhentai\b|\becchi\b|\beroge\b|creampie|squirt|\bnsfw\b|\bntr\b|에로|三[级級]|"
    r"thz\.la|7sht\.me|44x\.me|168x\.me|\b69av\b|deeper\.com|sexart\.com|topxdvd|jvid\.com|xchina|tooziq|sogclub|\btokyo[-\s]?hot\b|\bchaturbate\b|\bczechcasting\b|\bczechav\b|\bheydouga\b|\bblacksonblondes\b|"
    r"\bpervmom\b|\bbreedme\b|\bkellymadison\b|\bcarib\b"
)
SOFTWARE_WORDS = (
    r"\bRTM\b|\bLTSC\b|\bC2R\b|\bMultilingual\b|\bWinPE\b|\bx86_64\b|\bKeygen\b|\bActivator\b|\bx64\b|\bx86\b|\bWindows\s+(?:XP|Vista|\d+|Server)\b|\bAdobe\b|\bPhotoshop\b|\bIllustrator\b|\bPremiere\s+Pro\b|"
    r"\bAfter\s+Effects\b|\bAutoCAD\b|\bAutodesk\b|\b3ds\s+Max\b|\bSQL\s+Server\b|\bMicrosoft\s+Office\b|\bVisual\s+Studio\b"
)
#: A safety gate: names and paths that match are dropped before anything is stored or shown.
BLOCKED_WORDS = (
    r"pa?edo(?:fil\w*|phil\w*)?|\bpreteen\b|\bpthc\b|\bptsc\b|\blsbar\b|\blsm\b|\bunderage\b|\bhebefilia\b|\bopva\b|child ?porn\w*|child ?lover\w*|porno ?child\w*|kidd(?:y\w*|ie\w*) ?porn|young ?video ?models|"
    r"\bchildfugga\b|\bkinderkutje\b|\byvm\b|(?:#|1[0-7]) ?y ?o\b"
)
# End of the fixed values.

FANSUB = rf"(?i)^\[(?:{FANSUB_GROUPS})\]"


def _alternatives(pattern: str) -> list[str]:
    """What a pattern's top-level bars separate."""
    out, depth, start, inside, i = [], 0, 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


#: What begins a plain word in any case: not k and s, which fold to letters beyond ASCII, and nothing that may be left out.
_PLAIN = re.compile(r"[0-9A-JL-RT-Za-jl-rt-z_](?![?*{])")


def _by_first(parts: list[str]) -> str:
    """Alternatives by their first letter, in any case, so that a place in a text is held against letters before words."""
    groups: dict[str, list[str]] = {}
    for p in parts:
        groups.setdefault(p[0].lower() if re.match(r"[A-Za-z](?![?*+{])", p) else p, []).append(p)
    return "|".join(f"{same[0][0]}(?:{'|'.join(p[1:] for p in same)})" if len(same) > 1 and len(key) == 1 else "|".join(same) for key, same in groups.items())


def any_of(pattern: str) -> str:
    """Matches where any alternative does, in whatever order and case: those that begin at a word's edge look for it once."""
    parts = _alternatives(pattern)
    edge = [p[2:] for p in parts if p.startswith(r"\b")]
    rest = [p for p in parts if not p.startswith(r"\b")]
    groups = [[p for p in edge if _PLAIN.match(p)], [p for p in edge if not _PLAIN.match(p)]]
    return "|".join([rf"\b(?:{_by_first(g)})" for g in groups if g] + ([_by_first(rest)] if rest else []))


ADULT, SOFTWARE, BLOCKED = (f"(?i){any_of(words)}" for words in (ADULT_WORDS, SOFTWARE_WORDS, BLOCKED_WORDS))
#: What separates words of a name.
UNICODE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = r"\t\n\f\r "


def either(*patterns: str) -> str:
    """Any of the patterns, without regard to case and without their groups."""
    return any_of("|".join(re.sub(r"(?<!\\)\((?!\?)", "(?:", p.removeprefix("(?i)")) for p in patterns))


def up_to_first(*patterns: str) -> str:
    """Group 1 is all before the earliest match of any pattern, or the whole text."""
    return f"(?is)^(.*?)(?:{either(*patterns)}|$)"


TITLE_CUTS = (EPISODE_CUT, SEASON, SEASON_PACK, YEAR, RESOLUTION, ENCODING, DYNAMIC_RANGE, SOURCE)
TITLE = up_to_first(*TITLE_CUTS)
ANIME_TITLE = up_to_first(*TITLE_CUTS, ABSOLUTE_EPISODE)
#: The numbers of what EPISODE matched: those of its first and second groups, whichever form it has.
MARK_SEASON = r"(?i)^S?(\d{1,2})(?:E|x|\s)"
MARK_EPISODE = r"(?i)^(?:S?\d{1,2}(?:E|x|\s+[-–]\s+)|Ep\.?)(\d+)"


def _group(text: str) -> list[str]:
    """The alternatives of the group that ``text`` begins with, if it does."""
    head = re.match(r"\((?:\?:)?(?!\?)", text)
    if not head:
        return []
    depth, inside, i = 1, False, head.end()
    while depth:
        c = text[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        else:
            inside, depth = c == "[", depth + (c == "(") - (c == ")")
        i += 1
    return _alternatives(text[head.end() : i - 1])


def _edge(before: str, after: str) -> str:
    """A word edge; less is enough where what stands beside it is known to be a word's."""
    known = re.compile(r"[0-9A-Za-z_]|\\[dw]")
    if known.match(after):
        return f"(?<!{_WORD})"
    if re.search(r"(?<!\\)[0-9A-Za-z_]$", before):
        return f"(?!{_WORD})"
    group = _group(after)
    if group and all(_PLAIN.match(p) for p in group):
        return f"(?<!{_WORD})(?={_WORD})"
    return _EDGE


def java(pattern: str) -> str:
    """The Java pattern that matches what RE2 matches: ASCII word edges and spaces, the end of text only, Unicode case folding."""
    out, inside, i = ["(?d)"], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(_edge(pattern[:i], pattern[i + 2 :]))
        elif two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S":
            out.append(f"[^{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        elif two == "(?" and (m := re.match(r"\(\?([is]+)\)", pattern[i:])):
            out.append(f"(?{m[1].replace('i', 'iu')})")
            i += m.end()
            continue
        elif two[0] == "$" and not inside:
            out.append(r"\z")
            i += 1
            continue
        else:
            inside = (two[0] == "[") or (inside and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)
