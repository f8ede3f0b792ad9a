"""basaltiq.sources"""
