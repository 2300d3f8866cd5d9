"""The vocabulary of the query language, as data.

Every table states words and numbers the results depend on; the parser (intent.py) holds the logic.
"""

from __future__ import annotations

VEHICLES = ("car", "truck", "bus", "motorcycle")
PEOPLE = ("person",)
#: What detectors can see; only these constrain a frame as context.
DETECTABLE = ("car", "truck", "bus", "motorcycle", "person", "traffic_light")

#: (words, entities they stand for)
ENTITY_WORDS = (
    (("白色汽车", "白色轿车"), ("car",)),
    (("车牌",), ()),
    (("traffic light", "红绿灯", "信号灯"), ("traffic_light",)),
    (("stop line", "停止线"), ("stop_line",)),
    (("intersection", "路口", "交叉口"), ("intersection",)),
    (("crosswalk", "斑马线", "人行道"), ("crosswalk",)),
    (("lane", "车道"), ("lane",)),
    (("truck", "货车", "卡车"), ("truck",)),
    (("bus", "公交车", "巴士"), ("bus",)),
    (("motorcycle", "摩托车", "摩托"), ("motorcycle",)),
    (("person", "行人"), ("person",)),
    (("car", "汽车", "轿车", "小汽车", "车"), ("car",)),
    (("vehicle", "vehicles", "车辆"), ("car", "truck", "bus", "motorcycle")),
)
RELATION_WORDS = {
    "near": ("near", "附近", "靠近"),
    "inside": ("inside", "内", "在.*里"),
    "cross": ("cross", "crossing", "穿过", "跨过", "越过"),
    "entering": ("entering", "enter", "进入"),
    "leaving": ("leaving", "leave", "离开"),
    "left_of": ("left of", "左侧", "左边"),
    "right_of": ("right of", "右侧", "右边"),
}
DIRECTION_WORDS = {
    "left_to_right": ("left to right", "从左到右", "向右"),
    "right_to_left": ("right to left", "从右到左", "向左"),
    "top_to_bottom": ("top to bottom", "从上到下"),
    "bottom_to_top": ("bottom to top", "从下到上"),
}
MOTION_WORDS = {
    "turn_left": ("turn left", "左转"),
    "turn_right": ("turn right", "右转"),
    "stop": ("stop", "停车", "停住"),
    "park": ("park", "停靠", "停放"),
}
#: Event words by tier; the tier is the confidence.
EVENT_TIERS = {"direct": 1.0, "descriptive": 0.8, "colloquial": 0.7, "implicit": 0.6}
EVENT_WORDS = {
    "wrong_way_driving": {
        "direct": ("逆行", "逆向行驶", "反向行驶", "反方向行驶", "逆方向行驶", "机动车逆行", "车辆逆行", "汽车逆行"),
        "descriptive": (
            "朝错误方向行驶", "朝相反方向移动", "朝相反方向行驶", "车辆方向与道路规定相反", "违反道路行驶方向", "驶入对向车道", "进入反向道路",
            "进入对向车道", "违规反向行驶", "不按规定方向行驶", "反向驶入道路", "逆向通过道路",
        ),
        "colloquial": (
            "开反了", "走反方向", "开反方向的车", "走错方向", "开错方向", "反着开", "逆着开", "逆着车流行驶", "对着开", "反着来", "不按规定路线走",
            "不按规定路线行驶",
        ),
        "implicit": ("方向异常", "方向不对", "走错路", "开错路", "方向与道路规定相反", "错误方向", "相反方向", "反方向", "对向", "反向"),
    },
    "red_light_violation": {
        "direct": ("闯红灯", "冲红灯", "红灯违规", "红灯违章", "红灯违法", "车辆闯红灯", "机动车闯红灯"),
        "descriptive": (
            "红灯时通过路口", "红灯亮时通行", "红灯亮时车辆通过路口", "红灯状态下继续行驶", "红灯期间通过交叉路口", "违反交通信号灯", "未遵守红绿灯规则",
            "不按交通信号通行", "红灯时通过", "禁止通行时间通过路口", "信号灯违规",
        ),
        "colloquial": (
            "抢红灯", "不守红绿灯", "不守信号灯", "闯信号灯", "冲信号灯", "无视红灯", "忽略红灯", "不等红灯", "不等红灯继续行驶", "没有等待红灯",
            "小车冲过红灯", "冲过红灯",
        ),
        "implicit": ("红灯时", "红灯期间", "红灯亮", "红灯状态", "违反信号", "不守灯", "闯灯"),
    },
    "vehicle_crosses_line": {
        "direct": ("压线", "压线行驶", "跨线", "跨线行驶", "越线行驶", "车辆压线", "货车压线"),
        "descriptive": (
            "越过车道线", "跨越道路标线", "驶过车道边界", "偏离正常车道", "越过分界线", "占用其他车道", "未保持在车道内", "压道路实线", "压道路标线",
            "越过道路标线行驶", "压着道路标线开",
        ),
        "colloquial": ("压到线", "压着线开", "压着标线开", "越过线了", "没有保持车道", "没守车道", "跑偏了", "大车压到线", "货车压到线"),
        "implicit": ("车道偏离", "不按车道行驶", "偏离车道", "没有保持在车道", "压道路"),
    },
}
#: Implied events: (event, words of which one is needed, words all needed, context of which one is needed)
IMPLIED_CONFIDENCE = 0.7
IMPLIED_EVENTS = (
    (
        "wrong_way_driving", ("错误方向", "相反方向", "反方向", "对向", "反向", "走错", "开错", "逆着", "反着", "对着开"), (),
        ("道路", "车道", "行驶", "驾驶", "开", "车", "通过", "驶入", "进入"),
    ),
    (
        "red_light_violation", ("通过", "通行", "行驶", "继续", "冲", "抢", "忽略", "无视", "不等", "没有等待", "闯"), ("红灯",), (),
    ),
    (
        "vehicle_crosses_line", ("偏离", "越过", "跨越", "占用", "没有保持", "压"), (),
        ("车道", "标线", "实线", "分界线", "边界", "线"),
    ),
)
#: Literal words that name an event outright, at the weakest confidence.
NAMED_CONFIDENCE = 0.5
NAMED_EVENTS = {
    "red_light_violation": ("red light violation", "red_light_violation", "闯红灯", "冲红灯", "红灯违规", "红灯违章", "红灯违法"),
    "vehicle_crosses_line": ("cross line", "vehicle_crosses_line"),
}
#: Whole queries that are an event's name, for the event channel.
EVENT_NAMES = {
    "vehicle_crosses_line": ("vehicle_crosses_line", "cross line", "line crossing", "压线", "车辆压线", "压线行驶", "跨线", "跨线行驶"),
    "wrong_way_driving": (
        "wrong_way_driving", "wrong way driving", "wrong way", "逆行", "车辆逆行", "反向行驶", "逆向行驶", "逆方向行驶", "反方向", "opposite direction",
    ),
    "red_light_violation": (
        "red_light_violation", "red light violation", "闯红灯", "车辆闯红灯", "冲红灯", "红灯违规", "红灯违章", "红灯违法", "违反红灯", "running red light",
    ),
}
ATTRIBUTE_WORDS = {
    "color": {
        "white": ("白色", "白车", "浅色", "颜色较浅", "较浅", "白"),
        "red": ("红色", "红车"),
        "black": ("黑色", "黑车"),
        "blue": ("蓝色", "蓝车"),
        "yellow": ("黄色", "黄车"),
    },
    "vehicle_type": {
        "car": ("汽车", "轿车", "小汽车", "小车", "机动车"),
        "truck": ("货车", "卡车", "大车", "大货车", "大型车辆"),
        "bus": ("公交车", "巴士", "大巴"),
        "motorcycle": ("摩托车", "摩托"),
    },
    "light_state": {
        "red": ("红灯", "红灯亮", "红灯状态", "红灯时", "红灯期间"),
        "green": ("绿灯",),
        "yellow": ("黄灯",),
    },
}
#: Names of the light itself, which say nothing about its state.
LIGHT_NAMES = ("红绿灯", "信号灯")
#: Plain words of the older attribute rules, in order of precedence.
PLAIN_ATTRIBUTES = {
    "light_state": (("red", "red light", "红灯"), ("yellow", "yellow light", "黄灯"), ("green", "green light", "绿灯")),
    "duration": (("long", "长时间", "long time", "for a long time"),),
    "color": (("white", "white", "白色"), ("black", "black", "黑色")),
}
VAGUE_WORDS = ("违规", "违章", "违法", "不正常", "异常", "不合规", "不按规定")
EXACT_REWRITES = {
    "白色汽车": ("white car", "white sedan", "white vehicle", "car"),
    "白色轿车": ("white sedan", "white car", "white vehicle", "car"),
    "黑衣男子": ("man in black", "person wearing black clothes"),
    "车牌": ("license plate", "vehicle plate"),
    "汽车": ("car",),
    "轿车": ("car",),
    "货车": ("truck",),
    "卡车": ("truck",),
    "公交车": ("bus",),
    "摩托车": ("motorcycle",),
    "红绿灯": ("traffic light",),
    "行人": ("person",),
    "车辆": ("car", "truck", "bus", "motorcycle"),
}
EVENT_SYNONYMS = {
    "逆行": ("车辆逆行", "车辆逆向行驶", "机动车逆行", "车辆反方向行驶", "逆向行驶"),
    "闯红灯": ("车辆闯红灯", "冲红灯", "红灯违规", "红灯违章"),
    "压线": ("车辆压线", "压线行驶", "跨线行驶", "车辆越线"),
}
#: What an event's description says after the label.
EVENT_DESCRIPTIONS = {
    "vehicle_crosses_line": "越过车道线（压线）",
    "wrong_way_driving": "沿车道反向行驶（逆行）",
    "red_light_violation": "在红灯状态下越过停止线",
}
EVENT_ZH = {"wrong_way_driving": "逆行", "red_light_violation": "闯红灯", "vehicle_crosses_line": "压线"}
ENTITY_ZH = {
    "car": "汽车", "truck": "货车", "bus": "公交车", "motorcycle": "摩托车", "person": "行人", "traffic_light": "交通信号灯",
    "stop_line": "停止线", "intersection": "路口", "crosswalk": "斑马线", "lane": "车道",
}
COLOUR_ZH = {"white": "白色", "red": "红色", "black": "黑色", "blue": "蓝色", "yellow": "黄色"}

#: Channel weights (clip, detection, trajectory, event, ocr) by what the query is sure of.
CHANNELS = ("clip", "detection", "trajectory", "event", "ocr")
WEIGHTS = {
    "sure event": (0.05, 0.10, 0.15, 0.65, 0.05),
    "sure event, visual": (0.35, 0.10, 0.10, 0.35, 0.10),
    "likely event": (0.10, 0.25, 0.20, 0.35, 0.10),
    "attributes of entities": (0.50, 0.25, 0.10, 0.05, 0.10),
    "vague": (0.35, 0.20, 0.15, 0.15, 0.15),
}
EVENT_BOOST = {"red_light_violation": 0.15, "vehicle_crosses_line": 0.05, "wrong_way_driving": 0.03}
OTHER_BOOST, LESS_SURE = 0.03, 0.7
