"""Column names. They must equal the names users' tables carry."""

# Request field -> model column.
MODEL_NAMES = {
    "age": "Age",
    "gender": "Gender",
    "weight_kg": "Weight (kg)",
    "height_m": "Height (m)",
    "max_bpm": "Max_BPM",
    "avg_bpm": "Avg_BPM",
    "resting_bpm": "Resting_BPM",
    "session_duration_hours": "Session_Duration (hours)",
    "calories_burned": "Calories_Burned",
    "workout_type": "Workout_Type",
    "water_intake_liters": "Water_Intake (liters)",
    "workout_frequency_days_week": "Workout_Frequency (days/week)",
    "experience_level": "Experience_Level",
}

# The two engineered features.
ENGINEERED_NAMES = {"bmi": "BMI", "log_age": "Log_Age"}

SCORING_NAMES = {**MODEL_NAMES, **ENGINEERED_NAMES}

# The nine fields the exploratory trainings renamed.
PARTIAL_FIELDS = (
    "age", "weight_kg", "height_m", "max_bpm", "avg_bpm", "resting_bpm",
    "session_duration_hours", "gender", "workout_type",
)
PARTIAL_NAMES = {field: MODEL_NAMES[field] for field in PARTIAL_FIELDS}

FEATURE_FIELDS = tuple(SCORING_NAMES)
MODEL_COLUMNS = tuple(SCORING_NAMES.values())
TARGET_NAME = "Fat_Percentage"

PREDICTED = "predicted_fat_percentage"
REAL = "real_fat_percentage"

# Column order of the history table.
HISTORY_COLUMNS = (
    "timestamp", PREDICTED, REAL, "weight_kg", "session_duration_hours",
    "workout_type", "workout_frequency_days_week", "avg_bpm", "resting_bpm",
    "max_bpm", "calories_burned", "water_intake_liters", "experience_level",
    "height_m",
)

# Columns that identify or label a row and therefore are not features.
NON_FEATURES = ("user_id", "email", "timestamp", "date", PREDICTED, REAL)


def inverse(names: dict[str, str]) -> dict[str, str]:
    """Display name -> field."""
    return {display: field for field, display in names.items()}
