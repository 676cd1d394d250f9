"""Personal information in free text: find it, name its type, replace it.

Anchor expansion. One Aho-Corasick pass over the text finds anchors: at-signs in their
spellings, URL schemes, words before or after a person's name, street and block words,
and words that say what a number is. Each anchor hands its place to a deterministic
parser, which expands left and right, decides the exact boundary and validates
(calendar dates and check digits of identity numbers, numbering plans of telephones,
order of address parts, shape of names). Digit runs are the anchors of accounts; the
number words to their left decide between an identity number, a telephone and what is
no case (orders, tickets, parcels, invoices, views, scans).

The work is linear in the text; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Span = tuple[int, int, str]

# Surnames, stop words and cue words of the four languages.
_SURNAMES = set(
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤华施卫褚柳鲍俞费岑倪殷毕安常乐时傅皮卞齐康伍元卜穆萧祁米明计成谈茅庞纪舒屈项祝阮蓝闵席季麻强娄危童颜梅盛刁骆樊凌霍虞支柯管解应宗宣贲洪包诸左吉钮"
)
_COMPOUND = ["欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "司徒"]
_NOT_GIVEN = set("去来说要到才还被把让给从着过的了是我你他她它们在有和跟就都也不这那哪医师生姐哥妈爸叔婶姨嫂弟妹舅姑爷奶爹娘伯侄友桌士夫先主任太总店家人牙院所个")
_NOT_NAME_ZH = {"楼下", "楼上", "隔壁", "对门", "家里", "时候", "老公", "老婆", "同桌", "房东"}
_TITLES_ZH = ["医生", "大夫", "老师", "先生", "女士", "阿姨", "师傅", "主任", "护士", "小姐", "教授", "同学", "同事", "经理"]
_NOT_NAME_JA = {"同級生", "同僚", "先輩", "後輩", "店長", "看護師", "衛生士", "歯科衛生士", "先生", "医師", "両親", "祖母", "祖父", "友人", "家族", "主人", "旦那", "歯医者", "担当者", "受付", "姉", "妹", "兄", "弟", "母", "父", "夫", "妻", "姪", "甥", "叔父", "叔母", "娘", "息子", "彼氏", "彼女", "上司", "部長", "課長", "大学病院", "院長先生", "副院長"}
_KO_SURNAMES = set("김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용")
_NOT_NAME_KO = {"선생님", "의사", "원장님", "사장님", "어머니", "아버지", "이모", "고모", "언니", "오빠", "동생", "친구", "남편", "아내", "간호사", "위생사"}
_NOT_NAME_EN = {"the", "a", "an", "my", "me", "us", "them", "him", "her", "you", "it", "dr", "doctor", "dentist", "clinic", "dental", "smiles", "and", "or", "at", "on", "in", "of", "for", "to", "front", "desk", "reception", "support", "friend", "school", "she", "he", "they", "who", "that", "this", "mum", "uncle", "colleague", "flatmate", "cousin", "husband", "niece", "manager", "lady"}
_TITLES_EN = {"dr", "mr", "mrs", "ms", "miss", "prof", "sir", "dame", "nurse"}
_SUFFIX_EN = {"jr", "sr", "md", "phd", "dds", "ii", "iii"}
#: Words left of a number that make it no case.
_NO_CASE = ["订单号", "订单", "快递单", "快递", "运单", "单号", "发票代码", "发票", "号码", "片子编号", "编号", "阅读量", "取号", "排号", "票号", "流水号", "注文番号", "注文", "画像番号", "整理券", "閲覧数", "伝票", "追跡番号", "請求書", "チケット", "주문번호", "주문", "사진 번호", "조회수", "송장", "운송장", "대기번호", "예약번호", "영수증", "order", "scan", "ticket", "parcel", "invoice", "tracking", "views", "receipt", "booking", "挂号日期", "予約は", "예약은", "booked for", "qq", "no：", "no:"]
#: Words left of a number that make it an identity number, or a telephone.
_ID_CASE = ["身份证", "证件号", "证件", "护照", "社保号", "番号", "マイナンバー", "個人番号", "접수할 때", "주민", "주민등록번호", "my number", "ssn", "social security", "national id", "id number", "identity"]
_PHONE_CASE = ["电话", "手机", "微信", "微信同号", "同号", "号码是", "新号", "或者打", "打这个", "打", "收", "致电", "電話", "連絡先", "新しい番号", "相談は", "携帯", "연락처", "전화", "번호는", "문의는", "휴대폰", "ring", "call", "text", "phone", "new number", "contact", "on", "mobile", "tel"]

_GAP = "[ \t 　​﻿]"
_H = "[㐀-䶿一-鿿々〇]"
_FOLD = str.maketrans("０１２３４５６７８９－（）＋．　", "0123456789-()+. ")
_CN = {c: str(k) for k, c in enumerate("零一二三四五六七八九")} | {"〇": "0"}


def _folded(s: str) -> str:
    """Lower case and half width, character for character (offsets stay)."""
    low = s.lower()
    if len(low) != len(s):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in s)
    return low.translate(_FOLD)


# ---------------------------------------------------------------- e-mail and URLs
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:[.．][A-Za-z0-9-]+)*[.．][A-Za-z]{2,24}(?![A-Za-z0-9-])")
_SPACED = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:[.．]|\(dot\)|\[dot\])\s?|\s+dot\s+)(?:[A-Za-z0-9-]+(?:[.．]|\s+dot\s+))?[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.I)
_URL = re.compile(r"(?:https?://|www\.)[^\s一-鿿぀-ヿ가-힣，。！？、；<>\"'）)]*", re.I)


def _email(text: str, a: int, b: int, word: bool) -> Span | None:
    """Expand around an at-sign at text[a:b]; ``word`` for spelled-out and spaced forms."""
    left = a
    while left and text[left - 1] in "  ​" and a - left < 2:
        left -= 1
    right = b
    while right < len(text) and text[right] in "  ​" and right - b < 2:
        right += 1
    start = left
    while start and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
        start -= 1
    m = _LOCAL.match(text, start, left) if start < left else None
    while not m and start < left:
        start += 1
        m = _LOCAL.match(text, start, left)
    if not m:
        return None
    loose = word or left < a or right > b
    d = (_SPACED.match(text, right) if loose else None) or _DOMAIN.match(text, right)
    if not d:
        return None
    if word and text[a:b].strip().isalpha() and not re.search(r"[\d._+-]", m[0]) and " dot " not in d[0].lower():
        return None
    return start, d.end(), "EMAIL"


# ---------------------------------------------------------------- numbers
_RUN = re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?\d(?:[  \-–‐./()]{0,2}\d)*(?:[xX](?![a-z]))?(?![0-9])")
_CN_RUN = re.compile(r"[零〇一二三四五六七八九]{11,13}")


def _date_ok(y: int, m: int, d: int) -> bool:
    return 1 <= m <= 12 and 1 <= d <= (31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _id_zh(v: str) -> bool:
    """18 characters: region, birth date, sequence and a check digit modulo 11."""
    if not re.fullmatch(r"\d{17}[\dxX]", v) or not ("1900" <= v[6:10] <= "2099" and _date_ok(int(v[6:10]), int(v[10:12]), int(v[12:14]))):
        return False
    return "10X98765432"[sum(int(c) * (2 ** (17 - k) % 11) for k, c in enumerate(v[:17])) % 11] == v[17].upper()


def _id_ja(v: str) -> bool:
    """12 digits, the last a check digit modulo 11 (weights 2..7, 2..6 from the right)."""
    if not re.fullmatch(r"\d{12}", v):
        return False
    rest = sum(int(c) * (k + 1 if k <= 6 else k - 5) for k, c in zip(range(11, 0, -1), v)) % 11
    return int(v[11]) == (0 if rest <= 1 else 11 - rest)


def _id_ko(v: str) -> bool:
    """13 digits: birth date, then 1-8 for century and sex; newer ones have no check digit."""
    return bool(re.fullmatch(r"\d{6}[1-8]\d{6}", v)) and _date_ok(2000 if v[6] in "3478" else 1900, int(v[2:4]), int(v[4:6]))


def _id_en(raw: str) -> bool:
    return bool(re.fullmatch(r"\d{3}([ -])\d{2}\1\d{4}", raw)) and raw[:3] != "000" and raw[-4:] != "0000"


def _phone(raw: str, v: str, cued: bool) -> bool:
    """A telephone by numbering plan: mobile and fixed line of the four countries."""
    plus = raw.startswith("+")
    if v.startswith("0086"):
        v, plus = v[4:], True
    elif plus and v.startswith("86"):
        v = v[2:]
    elif plus and v.startswith("81"):
        return bool(re.fullmatch(r"81(?:0?[5789]0\d{8}|0?\d{9})", v))
    elif plus and v.startswith("82"):
        return bool(re.fullmatch(r"82(?:0?10\d{8}|0?\d{8,9})", v))
    elif plus and v.startswith("1"):
        return len(v) == 11
    elif plus and len(v) != 11:
        return 8 <= len(v) <= 15
    if re.fullmatch(r"1[3-9]\d{9}", v):
        return True
    if plus:
        return bool(re.fullmatch(r"0?\d{10,11}", v))
    if re.fullmatch(r"0[5789]0\d{8}|01[016789]\d{7,8}", v):
        return True
    if re.fullmatch(r"0\d{2,3}[ \-]\d{7,8}|0\d{1,4}[ \-]\d{1,4}[ \-]\d{4}|0\d{1,4}\(\d{1,4}\)\d{4}|\(0\d{1,4}\)\s?\d{3,4}-?\d{4}|\(0\d{2,3}\)\s?\d{7,8}", raw):
        return True
    if re.fullmatch(r"\(\d{3}\)\s?\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\1\d{4}", raw):
        return True
    if cued and re.fullmatch(r"\d{3} \d{3} \d{4}|[2-9]\d{2}[2-9]\d{6}|0\d{9,11}|400[ -]?\d{3}[ -]?\d{4}", raw):
        return True
    return False


def _numbers(text: str, low: str, blocked: list[tuple[int, int]], cues: dict[int, tuple[int, str]]) -> list[Span]:
    out: list[Span] = []
    for m in _RUN.finditer(low):
        a, b = m.span()
        raw = low[a:b]
        if raw[0] == "(" and ")" not in raw:
            a, raw = a + 1, raw[1:]
        for part_a, part_b in _parts(raw, a):
            raw = low[part_a:part_b]
            v = re.sub(r"[^0-9x]", "", raw)
            if len(v) < 8 or _touches(blocked, part_a, part_b):
                continue
            kind = _left_cue(low, part_a, cues)
            if kind == "no":
                continue
            if (len(v) == 18 and _id_zh(v)) or (len(v) == 12 and raw[0] != "0" and _grouped(raw, (4, 4, 4)) and _id_ja(v) and kind == "id") or (len(v) == 12 and kind == "id" and _id_ja(v)):
                out.append((part_a, part_b, "ID"))
            elif (len(v) == 13 and re.fullmatch(r"\d{6}[ \-–‐]?\d{7}", raw) and _id_ko(v)) or (len(v) == 9 and _id_en(raw.replace("–", "-"))):
                out.append((part_a, part_b, "ID"))
            elif _phone(raw, v.replace("x", ""), kind == "phone") and "x" not in v and kind != "id":
                out.append((part_a, part_b, "PHONE"))
    for m in _CN_RUN.finditer(text):
        v = "".join(_CN[c] for c in m[0])
        if _phone(v, v, False):
            out.append((m.start(), m.end(), "PHONE"))
    return out


def _grouped(raw: str, sizes: tuple[int, ...]) -> bool:
    return tuple(len(x) for x in re.split(r"[^0-9x]+", raw)) in (sizes, (sum(sizes),))


def _parts(raw: str, at: int) -> list[tuple[int, int]]:
    """A run as it is; if it is too long for a number, its pieces between double separators."""
    if len(re.sub(r"\D", "", raw)) <= 18:
        return [(at, at + len(raw))]
    out, k = [], 0
    for m in re.finditer(r"[ .]{1,2}", raw):
        out.append((at + k, at + m.start()))
        k = m.end()
    return [*out, (at + k, at + len(raw))]


def _left_cue(low: str, at: int, cues: dict[int, tuple[int, str]]) -> str:
    """What the words left of a number say of it: 'no', 'id', 'phone' or ''."""
    k = at
    while k and at - k < 4 and low[k - 1] in "  ​:：+(是为は는은,，、":
        k -= 1
    hit = cues.get(k)
    return hit[1] if hit else ""


# ---------------------------------------------------------------- addresses
_ZH_UNIT = re.compile(rf"(?:{_GAP}?(?:\d+号楼(?:{_GAP}?\d+单元)?(?:{_GAP}?\d+[室号]?)?|\d+[栋幢座](?:{_GAP}?\d+单元)?(?:{_GAP}?\d+[室号]?)?|{_H}{{2,6}}?(?:小区|花园|公寓|大厦|苑|新村|家园|广场)(?:{_GAP}?\d+(?:-\d+){{1,3}}|{_GAP}?\d+[栋幢座号](?:楼)?(?:\d+单元)?(?:\d+[室号]?)?)?))?")
_ZH_HEAD = re.compile(rf"(?:{_H}{{2,4}}?(?:省|自治区){_GAP}?)?(?:{_H}{{2,4}}?市{_GAP}?)?(?:{_H}{{2,4}}?[区县旗市]{_GAP}?)?(?:{_H}{{2,4}}?[镇乡]{_GAP}?)?{_H}{{1,5}}?(?:大道|路|街|巷|胡同|弄|里){_GAP}?\d+(?:弄\d+)?号$")
_ZH_FULL = re.compile(rf"(?:{_H}{{2}}(?:省|自治区))?(?:{_H}{{2}}市)?{_H}{{2}}[区县旗市]$")
_JA_BLOCK = re.compile(rf"{_GAP}?\d+(?:丁目{_GAP}?\d+(?:番地?(?:{_GAP}?\d+号?)?|[-－]\d+(?:[-－]\d+)?)?|(?:[-－‐]\d+){{1,3}}|番地?(?:\d+号?)?)(?:{_GAP}?[ァ-ヶー一-鿿]{{2,10}}{_GAP}?\d+(?:号室)?)?")
_KO_HEAD = re.compile(r"(?:[가-힣]{1,6}(?:도|특별시|광역시)\s)?(?:[가-힣]{1,6}시\s)?(?:[가-힣]{1,6}[구군]\s)?(?:[가-힣]{1,6}[동읍면]\s)?[가-힣]{1,8}(?:대로|로|길)$")
_KO_TAIL = re.compile(r"\s?\d+(?:번길\s?\d+)?(?:-\d+)?(?:,?\s\d+동\s\d+호|,?\s[가-힣]{1,6}(?:빌라|아파트|맨션|오피스텔|빌딩|하이츠)\s(?:\d+동\s)?\d+호|,?\s\d+호)?")
_EN_STREETS = ["street", "avenue", "close", "road", "lane", "drive", "way", "court", "place", "terrace", "crescent", "boulevard", "square", "grove", "gardens", "st", "ave", "rd", "blvd", "dr", "ln"]
_NOT_STREET = {"the", "a", "an", "at", "on", "in", "of", "to", "my", "people", "days", "hours", "weeks", "months", "years", "dollars", "is", "was", "and", "or", "for", "it", "by", "from", "with", "this", "that"}
_EN_HEAD = re.compile(r"(?<![\w-])\d{1,5}[A-Za-z]?\s+(?:[A-Za-z][\w'-]*\s+){1,3}$")
_EN_TAIL = re.compile(r"\.?(?:,?\s+(?i:apt|unit|flat|suite|apartment|#)\.?\s*\w{1,6})?(?:,\s+[A-Z][\w'-]+(?:\s[A-Z][\w'-]+(?=\s*(?:[,.?!;，。\n]|$)))?)?(?:,?\s+[A-Z]{2}\s+\d{5})?", re.S)
_EN_TAIL_LOW = re.compile(r"\.?(?:,?\s+(?:apt|unit|flat|suite|apartment|#)\.?\s*\w{1,6})?(?:,\s+[a-z][\w'-]+(?=\s*,))?", re.I)


#: Verbs and particles that end just before an address.
_ZH_LEAD = re.compile(r"^.*(?:寄到|寄往|送到|直接来|我家在|家在|住在|住|地址[是为]?[:：]?|位于|在|来|到|去)(?=.)")


def _address_zh(text: str, low: str, at: int) -> Span | None:
    """Expand from a 号 after a digit: road and districts to the left, block and room to the right."""
    k = at
    while k and (low[k - 1].isdigit() or low[k - 1] in " "):
        k -= 1
    if k == at:
        return None
    left = max(0, at - 40)
    head = text[left : at + 1]
    head_start = max((m.end() for m in re.finditer(r"[^㐀-䶿一-鿿0-9​ 　]", head)), default=0)
    lead = _ZH_LEAD.match(head[head_start:])
    if lead and re.search(r"(?:大道|路|街|巷|胡同|弄|里)", head[head_start + lead.end() :]):
        head_start += lead.end()
    m = None
    for s in range(head_start, len(head)):
        m = _ZH_HEAD.match(head, s)
        if m:
            break
    if not m or not re.search(r"[省市区县镇乡]", m[0]):
        return None
    tail = _ZH_UNIT.match(low, at + 1)
    return left + m.start(), tail.end(), "ADDRESS"


def _address_ja(text: str, low: str, at: int) -> Span | None:
    """Expand from a 町/丁目 before a digit: prefecture and city left, block and room right."""
    tail = _JA_BLOCK.match(low, at)
    if not tail:
        return None
    k = at
    while k and at - k < 30 and (re.match(rf"{_H}|[ヶケノ]", text[k - 1]) or text[k - 1] in "​"):
        k -= 1
    head = text[k:at]
    m = re.search(r"(?:[^県府都道]{1,6}?[県府都道])?[^市区郡]{1,6}?[市区郡].{1,8}$", head, re.S)
    if not m:
        return None
    return k + m.start(), tail.end(), "ADDRESS"


def _address_ko(text: str, low: str, at: int) -> Span | None:
    """Expand from a 로/길 before a number."""
    tail = _KO_TAIL.match(low, at)
    if not tail or not re.search(r"\d", tail[0]):
        return None
    left = max(0, at - 40)
    best = None
    for s in (m.start() for m in re.finditer(r"(?<![가-힣])[가-힣]", text[left:at])):
        m = _KO_HEAD.match(text[left:at], s)
        if m and re.search(r"[시구군]\s", m[0]):
            best = left + s
            break
    return (best, tail.end(), "ADDRESS") if best is not None else None


def _address_en(text: str, a: int, b: int) -> Span | None:
    """Expand from a street word: house number left, unit and town right."""
    left = max(0, a - 50)
    m = _EN_HEAD.search(text[left:a])
    if not m or any(w.lower() in _NOT_STREET for w in m[0].split()[1:]):
        return None
    capital = text[left + m.end() - len(m[0].split()[-1]) - 1 : left + m.end()].strip()[:1].isupper()
    tail = (_EN_TAIL if capital else _EN_TAIL_LOW).match(text, b)
    end = tail.end()
    if text[end - 1 : end] == "." and end == b + 1:
        end = b
    return left + m.start(), end, "ADDRESS"


# ---------------------------------------------------------------- names
_EN_WORD = r"[A-Za-z][A-Za-z'’]*(?:-[A-Za-z]+)*"
_EN_NAME = re.compile(rf"{_EN_WORD}(?:\s+(?:[A-Za-z]\.|{_EN_WORD})){{1,3}}")
_KO_NAME = re.compile(r"[가-힣]{2,4}")


def _name_zh_right(text: str, at: int, stops: re.Pattern) -> Span | None:
    """A full name that starts at ``at`` and is followed by one of ``stops``."""
    while at < len(text) and text[at] in " 　​：:是叫":
        at += 1
    for n in (3, 2, 4):
        if _full_name_zh(text[at : at + n]) and stops.match(text, at + n):
            return at, at + n, "NAME"
    return None


def _name_zh_left(text: str, end: int) -> Span | None:
    """A full name that ends at ``end``, the longest that begins with a surname."""
    while end and text[end - 1] in " 　​":
        end -= 1
    for n in (3, 2):
        if end >= n and _full_name_zh(text[end - n : end]) and not (n == 2 and re.match(_H, text[end - 3 : end - 2] or " ")):
            return end - n, end, "NAME"
    return None


def _full_name_zh(s: str) -> bool:
    if not re.fullmatch(rf"{_H}{{2,4}}", s) or any(t in s for t in _TITLES_ZH):
        return False
    if any(p in s for p in _NOT_NAME_ZH):
        return False
    given = s[2:] if s[:2] in _COMPOUND else s[1:] if s[0] in _SURNAMES else ""
    return 1 <= len(given) <= 2 and not set(given) & _NOT_GIVEN


def _name_ja(text: str, at: int, end: int, left: bool) -> Span | None:
    """A family and given name in kanji, from ``at`` (left=False) or ending at ``end``."""
    if left:
        m = re.search(rf"(?:{_H}|ヶ|ノ){{1,4}}[ 　​]{{0,2}}{_H}{{1,3}}$", text[max(0, end - 10) : end])
        if not m:
            return None
        a, b = max(0, end - 10) + m.start(), end
    else:
        while at < len(text) and text[at] in " 　​：:":
            at += 1
        m = re.compile(rf"(?:{_H}|ヶ|ノ){{1,4}}[ 　​]{{1,2}}{_H}{{1,3}}|{_H}{{3,6}}").match(text, at)
        if not m:
            return None
        a, b = m.span()
        if text[b - 1] in "宛様氏殿" or text[b - 1 : b + 1] == "先生":
            b -= 1
    s = re.sub(r"[ 　​]", "", text[a:b])
    if not 3 <= len(s) <= 6 or s in _NOT_NAME_JA or any(s.endswith(x) for x in _NOT_NAME_JA if len(x) > 1) or re.search("歯科|病院|医院|口腔|番号|先生", s):
        return None
    return a, b, "NAME"


def _name_ko(text: str, at: int, end: int, left: bool) -> Span | None:
    if left:
        while end and text[end - 1] in " ​":
            end -= 1
        a = end
        while a and "가" <= text[a - 1] <= "힣" and end - a < 5:
            a -= 1
    else:
        while at < len(text) and text[at] in " ​：:":
            at += 1
        m = _KO_NAME.match(text, at)
        if not m:
            return None
        a, end = m.span()
    s = text[a:end]
    return (a, end, "NAME") if 3 <= len(s) <= 4 and s[0] in _KO_SURNAMES and s not in _NOT_NAME_KO and not s.endswith("님") else None


def _name_en(text: str, at: int, right: re.Pattern, capital: bool) -> Span | None:
    """Two to four name words (initials allowed) from ``at``, then ``right``.

    ``capital``: only capitalised words count; else a text in one case is read too.
    """
    while at < len(text) and text[at] in " ​\n:":
        at += 1
    m = _EN_NAME.match(text, at)
    if not m:
        return None
    words = [(x.start(), x.end(), x[0]) for x in re.finditer(r"\S+", m[0])]
    while words and words[0][2].lower().strip(".") in _TITLES_EN:
        words.pop(0)
    title = bool(words) and words[0][2][0].isupper() and not words[0][2].isupper()
    if title:  # in ordinary case a name is its leading capitalised words
        while words and not words[-1][2][0].isupper():
            words.pop()
        words = words[: next((k for k, w in enumerate(words) if not w[2][0].isupper()), len(words))]
        while words and words[-1][2].lower().strip(".") in _SUFFIX_EN:
            words.pop()
    elif capital:
        return None
    for n in range(min(4, len(words)), 1, -1) if title else range(2, min(3, len(words)) + 1):
        part = words[:n]
        if any(w.lower().strip(".,") in _NOT_NAME_EN for _, _, w in part):
            continue
        a, b = at + part[0][0], at + part[-1][1]
        if right.match(text, b):
            return a, b, "NAME"
    return None


def _name_en_left(text: str, end: int) -> Span | None:
    left = max(0, end - 60)
    m = re.search(rf"(?:(?<=^)|(?<=[.!?\n。！？] )|(?<=[\n.。！？!?…]))\s*({_EN_WORD}(?:\s+(?:[A-Za-z]\.|{_EN_WORD})){{0,2}}\s+{_EN_WORD})\s*$", text[left:end])
    m = m or re.search(rf"((?:[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)(?:\s+[A-Z]\.)?\s+[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)\s*$", text[left:end])
    if not m:
        return None
    words = m[1].split()
    capital = re.search(r"((?:[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)(?:\s+[A-Z]\.)?\s+[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)$", m[1])
    if capital:
        words = capital[1].split()
        a = left + m.start(1) + capital.start(1)
    else:
        a = left + m.start(1)
    if len(words) > 3 or any(w.lower().strip(".") in _NOT_NAME_EN | _TITLES_EN for w in words):
        return None
    return a, left + m.end(1), "NAME"


_STOP_ZH = re.compile(r"[ 　​]*(?:[，,。.；;、：:！!？?\n）)]|$|电话|手机|收|证件|身份证|手很|退款|一起|我才|推荐|[0-9+])")
_EN_ON = re.compile(r"\s+(?:on|at|via)\s+[+(\d]|\s*[,:]?\s*[+(]?\d", re.I)
_EN_CALLED = re.compile(r"\s+(?:\w+\s+times|three times|twice|again|before)", re.I)
_EN_WAS = re.compile(r"\s+(?:was|is|did|has|were|who|showed|told|explained|numbed|cleaned)\b", re.I)
_EN_END = re.compile(r"\s*(?:[.,;!?，。！？\n]|$)")

#: What may follow a full name that a verb or relation word leads to.
_AFTER_ZH = re.compile(r"[ 　​]*(?:[，,。.；;、：:！!？?\n）)]|$|[我你他她去来说是在就才也很给帮让打发问做看拔补手一推退收电身证带陪要告送过到和跟的])")
_CALLED_ZH = re.compile(r"(?:喊|叫|念)(?:了|过)?[一二两三四五六七八九十几好多\d]+$")
#: Frequent Japanese family names, for names that only さん or 氏 marks.
_SURNAMES_JA = ["佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "渡邊", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "清水", "山崎", "阿部", "池田", "橋本", "山下", "石川", "中島", "前田", "藤田", "小川", "後藤", "岡田", "長谷川", "村上", "近藤", "石井", "斎藤", "斉藤", "坂本", "遠藤", "青木", "藤井", "西村", "福田", "太田", "三浦", "藤原", "岡本", "松田", "中川", "中野", "原田", "小野", "田村", "竹内", "金子", "和田", "中山", "石田", "上田", "森田", "柴田", "酒井", "宮崎", "横山", "高木", "安藤", "宮本", "大野", "小島", "谷口", "今井", "工藤", "高田", "増田", "丸山", "杉山", "村田", "大塚", "新井", "小山", "平野", "藤本", "河野", "上野", "野口", "武田", "松井", "千葉", "菅原", "岩崎", "久保", "木下", "佐野", "野村", "松尾", "市川", "菊地", "杉本", "古川", "大西", "島田", "水野", "桜井", "高野", "吉川", "山内", "西田", "飯田"]
_KNOWN_JA = re.compile(rf"(?:{'|'.join(_SURNAMES_JA)})[ 　​]?(?:{_H}|[ぁ-んァ-ヶー]){{1,3}}$")
#: Words for a person, before whose name they stand.
_PEOPLE_EN = ["neighbour", "neighbor", "friend", "colleague", "coworker", "cousin", "brother", "sister", "roommate", "flatmate", "boss", "teacher", "husband", "wife", "aunt", "uncle", "son", "daughter", "partner", "patient", "dentist", "assistant", "receptionist", "hygienist"]
_EN_ANY = re.compile(r"(?![A-Za-z])")
_CAPITALS = re.compile(rf"\s+((?:[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)(?:\s+[A-Z]\.)?\s+[A-Z][a-z'’]+(?:-[A-Z][a-z]+)*)(?![A-Za-z-])")


def _name_en_capital(text: str, at: int) -> Span | None:
    """Two capitalised words (an initial between them) right of a title or a word for a person."""
    m = _CAPITALS.match(text, at)
    if not m or any(w.lower().strip(".") in _NOT_NAME_EN | _TITLES_EN for w in m[1].split()):
        return None
    return m.start(1), m.end(1), "NAME"


def _name_ja_known(text: str, end: int) -> Span | None:
    """A full name with a frequent family name that ends at ``end``."""
    m = _KNOWN_JA.search(text[max(0, end - 9) : end])
    return (max(0, end - 9) + m.start(), end, "NAME") if m else None


def _address_ja_blocks(text: str, at: int) -> Span | None:
    """Expand from a prefecture word: the prefecture's name left, city, place and blocks right."""
    tail = re.compile(rf"(?:[^\s、。\d]{{1,6}}?[市区郡])[^\s、。\d]{{0,10}}\d+(?:[-－‐]\d+){{1,3}}(?:{_GAP}?[ァ-ヶー一-鿿]{{2,10}}{_GAP}?\d+(?:号室)?)?").match(text, at)
    head = re.search(r"(?:東京|大阪|京都|北海|[一-鿿]{2,3})[都道府県]$", text[max(0, at - 4) : at])
    return (max(0, at - 4) + head.start(), tail.end(), "ADDRESS") if tail and head else None


_PASSPORT = re.compile(r"[ :：号是は]*([A-Z]{1,2}\d{7,8})(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])")


def _accounts(text: str) -> list[Span]:
    """Bank accounts by their international form and check digits modulo 97."""
    out: list[Span] = []
    for m in _IBAN.finditer(text):
        v = m[0].replace(" ", "")
        if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
            out.append((m.start(), m.end(), "ID"))
    return out


#: cue -> how to read a name next to it.
_NAME_CUES: dict[str, tuple] = {
    **{c: ("zh>",) for c in ["联系人", "本人", "写着", "医生叫", "护士叫", "大夫叫", "我叫", "名叫", "姓名", "收件人", "收货人", "跟", "找", "和", "患者"]},
    **{c: ("zh>>",) for c in ["陪", "带着", "请", "问了", "替", "邻居", "同事", "朋友", "同学", "表哥", "表姐", "室友", "房东", "老板"]},
    **{c: ("zh>n",) for c in ["遍", "次", "声"]},
    **{c: ("zh<",) for c in ["推荐的", "一起去的", "介绍的", "带我去", "陪我去", "收，", "收,", "收 ", *_TITLES_ZH]},
    **{c: ("jak",) for c in ["さん", "氏", "様", "先生", "くん", "ちゃん"]},
    **{c: ("ja>",) for c in ["連絡先は", "担当は", "受付で", "言われた、", "言われた,", "言われた ", "宛名は", "名前は", "氏名", "署名は", "号室の", "号の"]},
    **{c: ("ja<",) for c in ["宛で", "宛に", "宛て", "先生、", "さんと呼", "と一緒に", "に教わ", "様方", "が紹介"]},
    **{c: ("ko>",) for c in ["연락처는", "담당은", "접수에서", "적었다,", "적었다", "이름은", "성함은", "받는 사람"]},
    **{c: ("ko<",) for c in ["앞으로", "한테 배", "에게 배", "씨랑", "씨와", "씨가", "씨는", "씨한테", "님 하고", "님이라고"]},
    **{c: ("en>", p, c in (" for ", "dentist ", "nurse ", "surgeon ")) for c, p in {"contact ": _EN_ON, "called ": _EN_CALLED, "hygienist ": _EN_WAS, "dentist ": _EN_WAS, "nurse ": _EN_WAS, "surgeon ": _EN_WAS, "signed ": _EN_END, ", for ": _EN_END, " for ": _EN_END, "name is ": _EN_END, "attention of ": _EN_END, "addressed to ": _EN_END, "ask for ": _EN_END, "attn ": _EN_END}.items()},
    **{c: ("en<",) for c in [" recommended", *(f" {v} with me" for v in ("came", "went", "sat", "stayed", "waited", "walked", "drove")), *(f" {v} me" for v in ("taught", "told", "helped", "drove", "warned", "phoned", "texted"))]},
    **{c: ("enC",) for c in [*_PEOPLE_EN, *("dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "prof", "prof.", "professor", "doctor")]},
}


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple]] = {}
    add = lambda word, *what: found.setdefault(word, []).append((len(word), *what))
    for w in ("@", "＠"):
        add(w, "email", False)
    for w in ("(at)", "[at]", "{at}", " at ", "（at）"):
        add(w.translate(_FOLD), "email", True)
    for w in ("http://", "https://", "www."):
        add(w, "url")
    add("号", "zh号")
    for w in ("都", "道", "府", "県"):
        add(w, "ja県")
    for w in ("护照", "護照", "パスポート", "여권", "passport"):
        add(w, "passport")
    for w in ("町", "丁目", "村", "区", "字"):
        add(w, "ja町")
    for w in ("로", "길"):
        add(w, "ko로")
    for w in _EN_STREETS:
        add(" " + w, "en street")
    for kind, words in (("no", _NO_CASE), ("id", _ID_CASE), ("phone", _PHONE_CASE)):
        for w in words:
            add(w, "cue", kind)
    for w, how in _NAME_CUES.items():
        add(w, "name", *how)
    a = ahocorasick.Automaton()
    for w, what in found.items():
        a.add_word(w, what)
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None
_PRIORITY = {"EMAIL": 0, "ADDRESS": 1, "ID": 2, "PHONE": 3, "NAME": 4}


def find_spans(text: str | None) -> list[Span]:
    """All items of a text as (start, end, type), in order, none overlapping another."""
    global _AUTOMATON
    if not text:
        return []
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    low = _folded(text)
    spans: list[Span | None] = []
    blocked: list[tuple[int, int]] = []
    cues: dict[int, tuple[int, str]] = {}
    for last, whats in _AUTOMATON.iter(low):
        b = last + 1
        for n, what, *arg in whats:
            a = b - n
            if what == "cue":
                if low[a].isascii() and low[a].isalpha() and a and low[a - 1].isascii() and low[a - 1].isalpha():
                    continue
                if b not in cues or n > cues[b][0]:
                    cues[b] = (n, arg[0])
            elif what == "name":
                how = arg[0]
                if how == "zh>":
                    spans.append(_name_zh_right(text, b, _STOP_ZH))
                elif how == "zh<":
                    spans.append(_name_zh_left(text, a))
                elif how == "zh>>":
                    spans.append(_name_zh_right(text, b, _AFTER_ZH))
                elif how == "zh>n":
                    if _CALLED_ZH.search(text[max(0, a - 8) : a]):
                        spans.append(_name_zh_right(text, b, _AFTER_ZH))
                elif how == "jak":
                    spans.append(_name_ja_known(text, a))
                elif how == "enC":
                    if not (a and low[a - 1].isalnum()):
                        spans.append(_name_en_capital(text, b))
                elif how[:2] == "ja":
                    spans.append(_name_ja(text, b, a, how[2] == "<"))
                elif how[:2] == "ko":
                    spans.append(_name_ko(text, b, a, how[2] == "<"))
                elif how == "en>":
                    if not (a and low[a].isalpha() and low[a - 1].isalpha()):
                        spans.append(_name_en(text, b, arg[1], arg[2]))
                else:
                    spans.append(_name_en_left(text, a))
            elif what == "email":
                spans.append(_email(text, a, b, arg[0]))
            elif what == "url":
                if not blocked or a >= blocked[-1][1]:
                    blocked.append((a, _URL.match(text, a).end()))
            elif what == "zh号":
                if a and (low[a - 1].isdigit() or low[a - 1] == " "):
                    spans.append(_address_zh(text, low, a))
            elif what == "ja町":
                if b < len(low) and (low[b].isdigit() or low[b] in " 　"):
                    spans.append(_address_ja(text, low, b))
            elif what == "ja県":
                spans.append(_address_ja_blocks(text, b))
            elif what == "passport":
                if m := _PASSPORT.match(text, b) or re.compile(r"(?:\s+(?:no|number|is|no\.))*\s+([A-Z]{1,2}\d{7,8})(?![0-9A-Za-z])", re.I).match(text, b):
                    spans.append((m.start(1), m.end(1), "ID"))
            elif what == "ko로":
                if b < len(low) and (low[b] == " " or low[b].isdigit()):
                    spans.append(_address_ko(text, low, b))
            elif what == "en street":
                if b == len(low) or not (low[b].isalnum() or low[b] in "-'"):
                    spans.append(_address_en(text, a + 1, b))
    spans += _numbers(text, low, blocked, cues)
    spans += _accounts(text)
    return _disjoint([s for s in spans if s and not (s[2] == "EMAIL" and _touches(blocked, s[0], s[0] + 1))])


def _touches(spans: Sequence[tuple], a: int, b: int) -> bool:
    """Whether a:b overlaps one of spans, which are sorted and disjoint."""
    k = bisect_left(spans, (a + 1,))
    return (k > 0 and spans[k - 1][1] > a) or (k < len(spans) and spans[k][0] < b)


def _disjoint(spans: list[Span]) -> list[Span]:
    """Of overlapping spans the one of higher rank stays, then the longer one."""
    kept: list[Span] = []
    for s in sorted(set(spans), key=lambda s: (_PRIORITY[s[2]], s[0] - s[1], s[0])):
        if not _touches(kept, s[0], s[1]):
            insort(kept, s)
    return kept


def redact_text(text: str | None, spans: Sequence[Span] | None = None) -> str | None:
    """The text with every item replaced by [TYPE]; everything else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_spans(text) if spans is None else spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row for each distinct item of a record: (key, pii_type, pii_text).

    Defined results: null and empty texts give no row; an item that occurs several times
    in a record counts once; repeated records each give their rows; a null key stays
    null; empty tables give an empty result; other columns aren't read, so names may
    clash. Narrow: one pass over the scan, no shuffle.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pii_type", T.StringType()), T.StructField("pii_text", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, kinds, texts = [], [], []
            for row, s in enumerate(b.column(1).to_pylist()):
                for kind, item in dict.fromkeys((k, s[x:y]) for x, y, k in find_spans(s)):
                    take.append(row)
                    kinds.append(kind)
                    texts.append(item)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return df.select(key, field).mapInArrow(search, schema)


def redact(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, redacted, n_items): each record's text with typed placeholders.

    null stays null and '' stays ''; every record gives one row.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("redacted", T.StringType()), T.StructField("n_items", T.IntegerType())])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [find_spans(s) for s in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(redact_text, texts, spans)), pa.string()), pa.array(list(map(len, spans)), pa.int32())], names=schema.names)

    return df.select(key, field).mapInArrow(replace, schema)
