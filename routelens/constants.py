"""Fixed values that the results depend on.

These are the reference pipeline's constants, stated once here.
"""

# --- fixed values (must equal the reference for identical results) ---------
SPLIT_NAMES = {0: "train", 1: "val", 2: "test"}
MIN_TRIP_LEN = 6            # points, inclusive
MAX_TRIP_LEN = 120          # points, inclusive
TARGET_SAMPLE_RATE = 15     # seconds; declared by the reference, never enforced
MAX_SPEED = 33.33           # m/s
MIN_SPEED = -33.33
MAX_ACCELERATION = 3.0      # m/s^2
MIN_ACCELERATION = -3.0
GRID_STEP_DEGREE = 0.0015
EARTH_RADIUS_M = 6371.0 * 1000
TRAIN_FRACTION = 0.8        # split bounds int(n*0.8), int(n*0.9)
VAL_FRACTION = 0.9
NEAR_EXCLUSION = 10         # nearest trips never used as negatives
KSEG = 6                    # k-segment resampling uses MIN_TRIP_LEN segments
POI_SEPARATOR = "、"    # '、' between place names

# Point feature columns in their fixed order; 'offset' follows as index 11.
TRIP_COLS = ["tod", "road", "road_prop", "lng", "lat", "weekday", "seq_i",
             "seconds", "speed", "acceleration", "heading_angle"]
FEATURE_COLS = TRIP_COLS + ["offset"]
# Columns scaled to [-1, 1] in the trip dataset (indices 0,3,4,8,9,10).
NORMALIZED_COLS = ["tod", "lng", "lat", "speed", "acceleration", "heading_angle"]
# Model view: discrete features (1,5,7) and continuous ones (0,3,4,8,9,10).
DISCRETE_COLS = ["road", "weekday", "seconds"]
CONTINUOUS_COLS = ["tod", "lng", "lat", "speed", "acceleration", "heading_angle"]

# Prompt texts.
WEEKDAYS_ZH = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]
WEEKDAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
               "Saturday", "Sunday"]
PREFIX_ZH = "这条轨迹发生于{weekday}的{hour}点，"
PREFIX_EN = "This trajectory happened at {hour} o'clock on {weekday}, "
PROMPT_PARTS = {
    "zh": {"start": "起点位于如下地点附近：", "end": "终点位于如下地点附近：",
           "traj": "途径：", "suffix": "这条轨迹总结成一个字为"},
    "en": {"start": "starts near", "end": ", ends near",
           "traj": ", passes through",
           "suffix": "This trajectory can be summarized into a word as:"},
}
TASK_SUFFIXES = {
    ("destination", "zh"): "目的地所在路段为",
    ("destination", "en"): "The destination is",
    ("tte", "zh"): "旅行时间为",
    ("tte", "en"): "The total travel time is",
    ("classification", "zh"): "该轨迹所属的司机可以被归纳为",
    ("classification", "en"): "该轨迹所属的司机可以被归纳为",
}
ANCHOR_WORDS = [
    "turn", "straight", "u-turn", "accelerate", "decelerate",
    "constant", "stop", "fast", "slow", "brake",
    "swerve", "cruise", "detour", "slide", "zigzag",
    "steady", "smooth", "erratic", "rough", "agile",
    "sluggish", "stationary", "dynamic", "overtake", "glide",
    "rapid", "rushed", "leisurely", "cautious", "reckless",
]
ANCHOR_WORDS_ZH = [
    "弯", "直", "加", "减", "回",
    "恒", "停", "快", "慢", "刹",
    "避", "巡", "绕", "滑", "曲",
    "稳", "顺", "乱", "粗", "敏",
    "缓", "静", "动", "超", "滑",
    "速", "急", "闲", "慎", "莽",
]
# --- end of fixed values ----------------------------------------------------

# Engine defaults of this package (not reference values).
BROADCAST_ROW_LIMIT = 200_000   # largest dimension table shipped whole to tasks
