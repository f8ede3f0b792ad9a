"""basaltiq.streaming"""
