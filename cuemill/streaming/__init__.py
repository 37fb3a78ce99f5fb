"""cuemill.streaming"""
