"""basaltiq.operators"""
