"""Schemas of the learning tables; sources are never inferred."""

from __future__ import annotations

TABLES = {
    "users": "id long, username string, email string, password_hash string, display_name string, experience_level string, confident_areas array<string>, onboarding_complete boolean, last_recommendation_id long, current_streak int, last_submission_date date, supabase_id string, created_at timestamp, updated_at timestamp",
    "problems": "id long, title string, difficulty string, topics string, pattern string, test_cases string, link string, acceptance_rate double, premium_only boolean, category string, likes int, dislikes int, similar_questions string, title_slug string, description string, created_at timestamp, updated_at timestamp",
    "submissions": "id long, user_id long, problem_id long, code_text string, verdict string, detected_pattern string, detected_confidence double, expected_pattern string, target_pattern string, gap_identified boolean, diagnosis_confidence double, time_taken_seconds int, attempt_number int, topic string, elo_before double, elo_after double, submitted_at timestamp",
    "topic_profiles": "user_id long, topic string, elo_rating double, attempt_count int, pass_count int, pattern_match_count int, accuracy double, recent_failures int, last_attempt_at timestamp, created_at timestamp, updated_at timestamp",
    "recommendations": "id long, user_id long, problem_id long, topic string, reason string, confidence_tier string, acted_on boolean, followed boolean, elo_delta_after double, created_at timestamp, acted_on_at timestamp",
    "gap_signals": "user_id long, pattern_id string, gap_strength double, frequency int, last_seen timestamp, created_at timestamp, updated_at timestamp",
    "user_pattern_elo": "user_id long, pattern_id string, elo double, last_updated timestamp, created_at timestamp, updated_at timestamp",
    "problem_ground_truth": "problem_id long, patterns array<string>, confidence map<string,double>, created_at timestamp, updated_at timestamp",
}
VERDICTS = ("pass", "fail", "error", "tle")
DIFFICULTIES = ("Easy", "Medium", "Hard")
