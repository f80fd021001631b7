"""Plans that cross modules: functions for SQL users."""
