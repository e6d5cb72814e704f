"""Operators on conversational and corpus text.  Nothing outside this folder imports it."""
