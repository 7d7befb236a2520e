"""Alphabets and thresholds that text operators take explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# Ranges of unified ideographs with the numeral zero, and the marks of the strict Chinese alphabet.
HAN_RANGES = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FA0E}\x{FA0F}\x{FA11}\x{FA13}\x{FA14}\x{FA1F}\x{FA21}\x{FA23}\x{FA24}\x{FA27}-\x{FA29}"
    r"\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81E}\x{2B820}-\x{2CEAD}\x{2CEB0}-\x{2EBE0}\x{2EBF0}-\x{2EE5D}\x{30000}-\x{3134A}\x{31350}-\x{33479}\x{3007}"
)
HAN_MARKS = "，。！？；：、（）《》〈〉“”‘’「」『』【】〔〕…—·"
FULL_WIDTH = {",": "，", ".": "。", "!": "！", "?": "？", ";": "；", ":": "：", "(": "（", ")": "）"}
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


# Leftovers of markup removal, in the order they are tested.
_INNER = "[，。！？；：、《》〈〉“”‘’「」『』【】〔〕…—·]"
ARTIFACTS = {
    "empty_parentheses": f"（{_INNER}*）",
    "empty_labeled_parentheses": f"（(?:学名|原名|别名|法语|英语|拉丁语|德语|日语|西班牙语|意大利语|荷兰语|俄语)：{_INNER}*）",
    "missing_numeric_slot": (
        "(?:总面积|面积)(?:约为|为|约|达)?[，；](?:位于|地处|坐落于|位在)(?:法国|中国|英国|德国|日本|美国|俄罗斯|西班牙|意大利|欧洲|亚洲|非洲|美洲|大洋洲)"
        "|(?:总面积|面积|总人口|人口|海拔)(?:约为|为|达)[，；。]"
    ),
}
# Phrases of advertising, keywords of subject fields, headings, matching delimiters.
SPAM = ("扫码关注", "点击下载", "关注公众号", "加微信", "博彩", "色情网站", "免费领取", "免责声明")
LATIN_SPAM = ("scan the code to follow", "click to download", "follow our account", "add us on wechat", "online gambling", "porn site", "claim it for free", "disclaimer")
KEYWORDS = {
    "法律与公共事务": ("法院", "诉讼", "刑法", "民法", "司法", "判决", "法律", "立法"),
    "金融与经济": ("银行", "金融", "证券", "股东", "债券", "财务", "股票", "经济"),
    "医疗与健康": ("医学", "疾病", "患者", "临床", "药物", "医院", "治疗", "健康"),
    "学术与科技": ("物理", "化学", "算法", "工程", "技术", "实验", "数学", "科学"),
    "教育": ("教学", "教师", "学生", "课程", "学校", "课堂", "学习", "教育"),
    "历史与文化": ("历史", "哲学", "文学", "文化", "诗歌", "艺术", "作家", "小说"),
    "农业与环境": ("农业", "农作物", "生态", "环境", "种植", "土壤", "水稻", "气候"),
}
KEYWORD_FAMILIES = ("education_web", "news")
SECTION = r"^\s*(?:【?篇[一二三四五六七八九十百\d]+|【?第[一二三四五六七八九十百\d]+(?:篇|章|回)|问[:：]|问题[一二三四五六七八九十百\d]*[:：])"
PAIRS = {"（": "）", "【": "】", "《": "》", "「": "」", "『": "』", "“": "”", "‘": "’"}
LATIN_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Policy:
    """An alphabet (as the inside of a character class), what counts as its letters, and limits of a paragraph."""

    name: str
    letters: str
    marks: str
    least: int = 40
    most: int = 4096
    run: int = 10
    sentence_end: str = r"[.!?)\"']$"
    fragment: str = r"^[,.;:!?)]"
    full_width: bool = False
    phrases: tuple[str, ...] = ()

    @property
    def allowed(self) -> str:
        return f"^[{self.letters}{self.marks}]+$"


HAN_STRICT = Policy("han", HAN_RANGES, HAN_MARKS, full_width=True, sentence_end="[。！？；”’」』]$", fragment="^[，。！？；：、…—·]", phrases=SPAM)
LATIN_STRICT = Policy("latin", r"\p{L}\p{M}", r" ,.;:!?()'\"\-", phrases=LATIN_SPAM)
