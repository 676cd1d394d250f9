import pytest

from threadmill.llm.pii import find_pii, find_spans, redact, redact_text


def items(s):
    return {(k, s[a:b]) for a, b, k in find_spans(s)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("病历发到limei2646@inbox.example就行", {("EMAIL", "limei2646@inbox.example")}),
        ("oskel.1077＠mail.example这个邮箱", {("EMAIL", "oskel.1077＠mail.example")}),
        ("nalu.3933 at mail dot example，急", {("EMAIL", "nalu.3933 at mail dot example")}),
        ("write to a_8(at)web.invalid for slots", {("EMAIL", "a_8(at)web.invalid")}),
        ("请写信 q7@ post . test 或者打 176 00 86 33 60。", {("EMAIL", "q7@ post . test"), ("PHONE", "176 00 86 33 60")}),
        ("look at this example", set()),
        ("@棠川打卡姐 说得对", set()),
        ("联系人孔槿槿，电话176 0088 9617。", {("NAME", "孔槿槿"), ("PHONE", "176 0088 9617")}),
        ("打 一七六零零五零八一三零。", {("PHONE", "一七六零零五零八一三零")}),
        ("新号0086-19900209304", {("PHONE", "0086-19900209304")}),
        ("挂号要身份证994314198402016499，本人王峤屿。", {("ID", "994314198402016499"), ("NAME", "王峤屿")}),
        ("挂号要身份证994314198402016490，本人朋友。", set()),
        ("订单号933188498722090282还没发货", set()),
        ("快递单658950250327卡住，发票代码986633769923，号码63166185", set()),
        ("链接 https://shop-a.example/p/13800138000 自己看", set()),
        ("我家在岫岚市菖川区珩浦街164号20号楼2单元876，附近", {("ADDRESS", "岫岚市菖川区珩浦街164号20号楼2单元876")}),
        ("去珩麓路的小诊所看了5号医生", set()),
        ("家は榛坂県碧ノ瀬市霧里町7丁目24番20号霧ハイツ388号室なので", {("ADDRESS", "榛坂県碧ノ瀬市霧里町7丁目24番20号霧ハイツ388号室")}),
        ("連絡先は霧島　凪紗、090(0031)9581です。", {("NAME", "霧島　凪紗"), ("PHONE", "090(0031)9581")}),
        ("高校の同級生と一緒に行った。茜沢デンタルにて", set()),
        ("注文番号334328128628がまだ届かない。", set()),
        ("집이 미르찬시 누리샘구 마루별로 136 나래빌라 415호인데", {("ADDRESS", "미르찬시 누리샘구 마루별로 136 나래빌라 415호")}),
        ("연락처는 윤여름, 010-0060-7997입니다.", {("NAME", "윤여름"), ("PHONE", "010-0060-7997")}),
        ("접수할 때 920902-2097825 적으라고 해서 적었다, 박채운.", {("ID", "920902-2097825"), ("NAME", "박채운")}),
        ("Contact Nadra J. Varnley on +1 434 555 0190.", {("NAME", "Nadra J. Varnley"), ("PHONE", "+1 434 555 0190")}),
        ("I live at 267 Thornwick Avenue, Apt 19A, Oskmere, any clinic?", {("ADDRESS", "267 Thornwick Avenue, Apt 19A, Oskmere")}),
        ("The form wanted my number 923-55-2854, signed Merra Oskell.", {("ID", "923-55-2854"), ("NAME", "Merra Oskell")}),
        ("bad for ten days. Order 130031363059 still has not shipped. Scan 788076-8519", set()),
    ],
)
def test_items(text, want):
    assert items(text) == want


def test_redaction_keeps_the_rest():
    assert redact_text("联系人孔槿槿，电话176 0088 9617。谢谢") == "联系人[NAME]，电话[PHONE]。谢谢"
    assert redact_text(None) is None and redact_text("") == ""
    s = "x" * 200_000 + " a1@b.test " + "号" * 50_000
    assert redact_text(s) == "x" * 200_000 + " [EMAIL] " + "号" * 50_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "a1@b.test a1@b.test", 1), (1, None, 2), (None, "a1@b.test", 3), (2, "", 4)], "id long, content string, pii_type int")
    got = sorted((tuple(r) for r in find_pii(df, "id", "content").collect()), key=repr)
    assert got == [(1, "EMAIL", "a1@b.test"), (None, "EMAIL", "a1@b.test")]
    assert redact(df, "id", "content").count() == 4
    assert find_pii(df.limit(0), "id", "content").count() == 0


#: Written by hand, not from the tables: (text, its items).
HELD_OUT = [
    ("昨天陪张伟明去拔牙，回来路上他一直捂着脸", [("NAME", "张伟明")]),
    ("王建国医生很耐心，就是排队久", [("NAME", "王建国")]),
    ("前台喊了两次李晓雯我都没听见", [("NAME", "李晓雯")]),
    ("护士叫了三声欧阳靖，没人应", [("NAME", "欧阳靖")]),
    ("同事陈思远介绍了一家诊所", [("NAME", "陈思远")]),
    ("请赵敏芝女士到二号诊室", [("NAME", "赵敏芝")]),
    ("朋友刘子涵说种植牙不疼", [("NAME", "刘子涵")]),
    ("收件人：周文博，手机 13912345678", [("NAME", "周文博"), ("PHONE", "13912345678")]),
    ("邮箱是 wen.bo_88@mail.example.org，欢迎来问", [("EMAIL", "wen.bo_88@mail.example.org")]),
    ("护照E12345678和身份证都带了", [("ID", "E12345678")]),
    ("My neighbour Sarah Connor pulled a molar.", [("NAME", "Sarah Connor")]),
    ("Mr John Smith said it hurt", [("NAME", "John Smith")]),
    ("Dr. Emily J. Clarke phoned me back", [("NAME", "Emily J. Clarke")]),
    ("My colleague Peter Hall-Jones waited with me", [("NAME", "Peter Hall-Jones")]),
    ("The receptionist Anna Berg was kind", [("NAME", "Anna Berg")]),
    ("Maria Gomez told me to rinse with salt water", [("NAME", "Maria Gomez")]),
    ("Send it to 12 Baker Street, Flat 3, London", [("ADDRESS", "12 Baker Street, Flat 3, London")]),
    ("passport no X1234567 was on the form", [("ID", "X1234567")]),
    ("pay to GB82 WEST 1234 5698 7654 32 please", [("ID", "GB82 WEST 1234 5698 7654 32")]),
    ("reach me at +44 20 7946 0958", [("PHONE", "+44 20 7946 0958")]),
    ("私の同僚の佐藤健太郎さんも同じ医院です", [("NAME", "佐藤健太郎")]),
    ("田中花子様へ、予約の件です", [("NAME", "田中花子")]),
    ("担当は高橋誠先生でした", [("NAME", "高橋誠")]),
    ("東京都新宿区西新宿2-8-1の歯科に行った", [("ADDRESS", "東京都新宿区西新宿2-8-1")]),
    ("電話は03-1234-5678です", [("PHONE", "03-1234-5678")]),
    ("김민수 씨랑 같이 치과에 갔다", [("NAME", "김민수")]),
    ("담당은 이서연 선생님이었다", [("NAME", "이서연")]),
    ("문의는 010-1234-5678로 주세요", [("PHONE", "010-1234-5678")]),
]
#: Nothing in these is an item.
CLEAN = [
    "医生说先消炎，三天后再来", "请大家推荐靠谱的牙医", "朋友陪我去的，护士态度很好", "叫了三次号都没轮到我", "楼上邻居装修吵得我牙疼", "The doctor told me to wait", "My friend and I went on Monday Morning", "Mr Smith said no",
    "患者さんが多かった", "佐藤さんは優しい", "歯医者さんに行った", "先生、ありがとうございます", "선생님이 친절했다", "my dentist was great",
]


def test_held_out_recall_by_type():
    found, whole = {}, {}
    for text, want in HELD_OUT:
        got = items(text)
        assert got <= set(want), (text, got)
        for kind, value in want:
            whole[kind] = whole.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + ((kind, value) in got)
    assert {k: round(found[k] / n, 2) for k, n in whole.items() if found[k] < 0.9 * n} == {}
    assert [t for t in CLEAN if items(t)] == []


def test_many_items_stay_linear():
    import time

    sizes, took = (4000, 16000), []
    for n in sizes:
        text = "".join(f"www.a{k}.example 联系人孔槿槿，电话176 0088 {9000 + k % 999}。" for k in range(n))
        began = time.perf_counter()
        assert len(find_spans(text)) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
