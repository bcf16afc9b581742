"""Fixed values that results depend on: classes, colours, weights and limits."""

from __future__ import annotations

#: Pixel classes and walk kinds.
CLASSES = {"UNKNOWN": 0, "LAND": 1, "URBAN": 2, "BUILT": 3, "WATER": 4, "GREEN": 5, "OPEN": 6, "GRAY": 7, "TRUNK": 8, "MAJOR": 9, "SEC_CASE": 10, "MINOR": 11, "MINOR_CASE": 12, "PATH": 13}
KINDS = {"NONE": 0, "MINOR": 1, "SECONDARY": 2, "MAJOR": 3, "PATH": 4, "TRUNK": 5, "PARK": 6}

#: Colour anchors in order: class, tolerance, zooms (None: all), colours.
PALETTE = [
    ("WATER", 2, None, "d5e8eb cde7ea cce7ea b0d0d6"),
    ("GREEN", 2, None, "e0ecd3 e6efd9 e7efd9 d9e9c9 dae9c9 d1e6c0 c5e1b2 e5efda"),
    ("OPEN", 2, None, "dfe1d7 e0e1d7 e0e1d8 dee1d7 dadcd7 d9ddd7 d8ddd6"),
    ("GRAY", 1, None, "dfdedc dfdedd e0dfdd e0dedc e0dfde e7e5e1 e6e4e0 e7e6e1 e6e5e2 dddddc dddddd"),
    ("BUILT", 1, (15, 16, 17), "f6efe4 f6efe5 f6f0e5 e4dcd0 e5dccf e5dcce e5dcd0 f3eadc f3eadb f0e4d1 f1e7d6 f0e3d0 e7dfcb"),
    ("BUILT", 1, (15, 16, 17), "e7dbc9 e7dbc8 e7dbca ecdfcb eee1ce ebe0ce"),
    ("URBAN", 1, (14,), "f5ede2 f5ede1 f8f4ec f8f4eb f8f3ea f6f0e7 f5ecde f5ecdf f9f5ee fbf6ed"),
    ("URBAN", 1, (15,), "f9f5ed fbf9f4"),
    ("URBAN", 1, (16, 17), "f9f6ef f9f6f0"),
    ("LAND", 1, None, "fbf8f3 fcf8f3 faf7f1 faf6f0 f0eee7 fdfbf8"),
    ("TRUNK", 2, None, "ffe9a5 fde2a1 fbdb98 fbdc98 fbdc99"),
    ("MAJOR", 2, None, "fefdd7 ffeabb ffeabc ffecbe"),
    ("SEC_CASE", 2, None, "ffedc0 ffeec0 ffeec1"),
    ("MINOR", 1, None, "ffffff fffffe fffdf9"),
    ("MINOR_CASE", 2, None, "fdebce fdebcf fdeccf fdecd1 fdedd4 fdefd7 fdefd8 fdefd9 fef0d5 fef0d7 fdf0db"),
    ("PATH", 1, None, "d7d7d7 dedcd8"),
]

#: Features of a candidate, in order.
FEATURES = ["green", "open", "water", "waterNear", "built", "major", "secondary", "minor", "thin", "path", "minorDensity", "elevGain", "slope"]

#: Score and cost weights of each tag.
SCORE_WEIGHTS = {
    "nature": {"green": 3.0, "open": 1.0, "built": -1.0, "major": -1.0},
    "urban": {"built": 2.0, "major": 0.8, "minor": 0.6, "green": -0.8},
    "quiet": {"green": 1.5, "open": 1.0, "major": -2.5, "built": -0.5},
    "lively": {"major": 1.5, "secondary": 0.8, "built": 1.5, "green": -0.5},
    "river": {"waterNear": 3.0, "water": 1.0},
    "alley": {"minor": 1.5, "thin": 2.0, "major": -2.0, "built": 0.8},
    "night": {"major": 1.2, "secondary": 0.6, "waterNear": 1.2, "built": 0.6},
    "cafe": {"minor": 1.5, "minorDensity": 1.5, "built": 1.5, "major": -0.5},
    "hill": {"elevGain": 2.5, "slope": 1.0},
    "flat": {"slope": -2.5},
}
COST_WEIGHTS = {
    "nature": {"nearGreen": -1.2}, "quiet": {"major": 1.0, "secondary": 0.5}, "lively": {"major": -0.7}, "river": {"nearWater": -1.5},
    "alley": {"thin": -1.0, "major": 1.2}, "night": {"major": -0.8, "nearWater": -0.4}, "flat": {"slope": 1.5},
}
COST_FIELDS = ["nearGreen", "nearWater", "major", "secondary", "thin", "slope"]

#: Cost of a metre by walk kind, its theme limits, and that of cells used before.
KIND_COST = {"MINOR": 1.0, "SECONDARY": 1.1, "MAJOR": 1.3, "PATH": 1.6, "TRUNK": 15.0, "PARK": 2.0}
THEME_MIN, THEME_MAX, REUSE, REUSE_CAP = 0.6, 3.0, 2.0, 8.0

#: Zoom and stops by minutes; distance bands as shares of the target, and sectors in degrees.
ZOOM, STOPS = {15: 17, 30: 16, 60: 15, 120: 14}, {15: 3, 30: 3, 60: 4, 120: 5}
BANDS = {"turn": (0.25, 0.34), "side": (0.11, 0.22), "mid": (0.17, 0.26), "widen": (0.12, 0.48)}
SIDE_SECTOR, MID_SECTOR, TURN_FALLBACK = (50.0, 110.0), (10.0, 40.0), 0.3
TOLERANCE, ACCEPT, ATTEMPTS, SCALE_MIN, SCALE_MAX, SCALE_POWER, TAU, TOP = 0.1, 0.3, 3, 0.5, 1.3, 0.8, 0.5, 5
TILE_PX, MAX_TILES, WINDOW_FACTOR, WALK_KMH = 512, 4, 2.2, 4.0

#: Metres within which features and stops are sought, strides, square metres of the least regions, and shares.
NEAR_GREEN_M, NEAR_WATER_M, FEATURE_M, DENSITY_M, SNAP_M, SNAP_RIVER_M, ELEMENT_M, SEEN_M = 60.0, 120.0, 60.0, 120.0, 150.0, 250.0, 60.0, 30.0
SHORE_STRIDE_M, MACRO_STRIDE_M, GREEN_LEAST_M2, WATER_LEAST_M2, OPEN_LEAST_M, GAIN_M, SLOPE_NORM = 120.0, 150.0, 800.0, 2000.0, 6.0, 40.0, 0.08
LEAST_CLASSIFIED, LEAST_REACHED, THIN_FACTOR, MOST_CANDIDATES, CONFIDENT = 0.4, 0.01, 1.2, 400, 0.8

#: Static courses: id, title, km, minutes, difficulty, latitude, longitude.
COURSES = [("sinsu", "신수동 골목길 코스", 1.2, 18, "쉬움", 37.5505, 126.9322), ("daeheung", "대흥동 골목길 코스", 1.8, 27, "보통", 37.5462, 126.9345)]

#: Labels of the tags, by id.
TAG_LABELS = {"nature": "자연적인", "urban": "도시적인", "quiet": "조용한", "lively": "활기찬", "river": "강변", "alley": "골목길", "night": "야경", "cafe": "카페 투어", "hill": "언덕", "flat": "평지"}


def target_metres(minutes: float) -> float:
    return minutes / 60 * WALK_KMH * 1000

#: What a stop without a label is called, by the kind of its candidate, and else.
PLACE_LABELS = {"green": "녹지 주변", "shore": "물가 주변", "built": "건물 주변"}
PLACE_LABEL = "산책 경유지"

#: The words and sentences of a course's card.
SENTENCES = {
    "walk": " 산책", "today": "오늘의 산책", "hard": "어려움", "medium": "보통", "easy": "쉬움", "green": "녹지 ", "places": "곳", "water": "강변 ", "metres": "m",
    "mood": " 분위기에 맞춰 주변 길을 이어 만든 ",
    "loop": "km 순환 코스예요.",
    "passes": " 구간을 지나요.",
    "climb": "오르막은 약 ",
    "climbed": "m예요.",
    "returns": "가까운 길에서 출발해 같은 지점으로 돌아와요.",
    "start": "출발점은 현재 위치에서 약 ",
    "away": "m 떨어진 길 위에 있어요.",
    "unread": "아이콘과 장소명 확인 없이 지도에 보이는 지형과 길로 구성했어요.",
    "guessed": "분위기는 지도 형태로 추정하며 소음이나 조명 상태는 확인하지 못해요.",
}
