"""Whole verbs composed of operators: analyse, build, list, verify, extract, patch, sign."""
