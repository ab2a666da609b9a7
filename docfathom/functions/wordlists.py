"""Fixed values of text analysis: word lists and weights that results depend on. Product names come as parameters."""

from __future__ import annotations

import re

# Weights and bounds of the fielded index and its ranking.
K1, B = 1.2, 0.75
TITLE_WEIGHT, URL_WEIGHT, BODY_WEIGHT = 3.0, 1.6, 1.0
BODY_CAP, SCAN_CAP = 1500, 280
ANSWER_WEIGHT = 0.5
COMMON_DF, RARE_DF, IDF_FLOOR = 0.08, 0.02, 3.2
POOL, RRF_K, LEXICAL_WEIGHT, PAGE_REST = 450, 10, 0.22, 0.3

# Word lists.
CJK_STOP_WORDS = "怎么样 怎么办 怎么 怎样 如何 什么 哪些 哪里 是否 多少 请问 帮我 一下 可不可以 能不能 有没有 这个 那个 我们 已经 可以 因为 所以 如果 但是 还是 就是 不是 没有 一个".split()
CJK_STOP_CHARS = "的了吗呢啊吧把是有个和或在给去到太很"
EN_STOP = "the and for with that this from are was will how what when your into onto not vs via".split()
GENERIC_WORDS = (
    "error errors err type docker static dynamic install update device network system model board linux python ubuntu version default config file image "
    "driver command script test data info failed failure warning unknown invalid name path port host user root ip usb sdk api app src bin doc bad gateway "
    "pending chain target match"
).split()
CJK_FILLER = (
    "一直 好像 提示 报错 失败 不行 没有 板子 这个 那个 怎么 如何 怎样 是不是 能不能 可不可以 一下 已经 现在 直接 根本 老是 完全 还是 出来 进去 出现 起来 上去 下来 什么 哪里 "
    "哪个 因为 所以 如果 但是 就是 不是 可以 应该 需要 问题 错误 之后 然后 或者 我们 你们 自己"
).split()
FRAGMENT_SKIP = (
    "the and for doc docs html htm index source light system driver sample board user guide advanced development basic application quick start hardware "
    "software introduction manual command linux python demo example examples content category overview config txt api dev img com www http https page main "
    "true false null test cn en js md cc pdf"
).split()
LEXICAL_CJK_STOP_WORDS = "怎么样 怎么 怎样 如何 什么 哪些 哪里 是否 多少 请问 帮我 一下 可不可以 能不能 有没有".split()
LEXICAL_STOP = (
    "a an the and or not to of in on for with from into onto by at as is are was were be been do does did can will how what when where which who why this "
    "that these those i me my we you your it if check please just about than then there here"
).split()
WEAK_TITLE = "docker error errors static install network system default config board linux image device type file user root info test data".split()

# Synonyms of general words, by what they add to a query.
SYNONYMS = {
    "flash": ["烧录", "burn"], "burn": ["烧录"], "wifi": ["wi-fi", "无线", "wireless"], "wireless": ["wifi", "无线"], "install": ["安装"], "uart": ["串口"], "串口": ["uart"],
    "ptq": ["量化"], "qat": ["量化"], "量化": ["ptq", "qat"], "烧录": ["flash"], "软件源": ["apt", "sources.list"], "apt": ["软件源"], "管脚": ["40pin", "引脚"],
    "引脚": ["40pin", "管脚"], "gpio": ["管脚"], "摄像头": ["camera", "mipi"], "camera": ["摄像头"], "无图": ["黑屏"], "黑屏": ["无图"], "无线": ["wifi"], "推理": ["inference"],
    "inference": ["推理"], "登录": ["login"], "login": ["登录"], "账号": ["账户", "account"], "账户": ["账号", "account"], "account": ["账号", "账户"], "密码": ["password", "口令"],
    "password": ["密码", "口令"], "口令": ["密码", "password"], "波特率": ["baud", "baudrate"], "baud": ["波特率"], "baudrate": ["波特率", "baud"], "静态": ["static"], "static": ["静态"],
    "大模型": ["llm", "大语言模型"], "大语言模型": ["llm", "大模型"], "llm": ["大模型", "大语言模型"], "nandflash": ["nand flash", "nand"], "norflash": ["nor flash"],
    "nosecure": ["non-secure"], "nonsecure": ["non-secure"], "typea": ["type-a"], "typec": ["type-c"], "uboot": ["u-boot"], "下载": ["烧录", "flashing"], "刷机": ["烧录", "flashing"],
    "烧入": ["烧录", "flashing"], "烧写": ["烧录", "flashing"], "登陆": ["登录"],
}

# Words whose synonyms serve the index only; the title score does not use them.
RETRIEVAL_ONLY = "ptq qat 量化 烧录 软件源 apt 管脚 引脚 gpio 摄像头 camera 无图 黑屏 无线 推理 inference".split()

#: Stop words of CJK runs, longest first; a stop character ends a segment before any word is tried.
CJK_BREAK = "[" + CJK_STOP_CHARS + "]|" + "|".join(sorted(map(re.escape, CJK_STOP_WORDS), key=len, reverse=True))
