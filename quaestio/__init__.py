"""A PySpark-native engine for question banks, answer keys, exams and study statistics."""
