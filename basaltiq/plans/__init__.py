"""basaltiq.plans"""
